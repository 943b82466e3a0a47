"""Recorded results of one crawl: postings per duty and years, and what follows from them."""

from pyspark.sql import functions as F

from postlens.operators import distribution as A

# Years -> number of postings.
COUNTS = {
    "AI": {0: 90, 1: 45, 2: 75, 3: 132, 4: 12, 5: 63, 6: 8, 7: 13, 8: 4, 10: 7},
    "ERP": {0: 1, 1: 3, 2: 4, 3: 11, 4: 8, 5: 6, 7: 4},
    "PM": {0: 12, 1: 12, 2: 11, 3: 36, 4: 3, 5: 48, 6: 5, 7: 11, 8: 7, 10: 7},
    "QA": {0: 26, 1: 19, 2: 20, 3: 49, 4: 10, 5: 25, 6: 3, 7: 7, 8: 1, 10: 2},
    "VR": {0: 3, 2: 3, 3: 5, 4: 1, 5: 3},
    "게임": {0: 3, 2: 3, 3: 10, 5: 7},
    "데이터 직무": {0: 53, 1: 22, 2: 49, 3: 101, 4: 21, 5: 74, 6: 6, 7: 23, 8: 8, 10: 9, 11: 2, 15: 1},
    "백엔드": {0: 110, 1: 73, 2: 128, 3: 429, 4: 77, 5: 296, 6: 39, 7: 83, 8: 30, 9: 3, 10: 38, 12: 1, 15: 3},
}
# Shares in percent.
RATIOS = {
    "AI": {0: 20.04, 1: 10.02, 2: 16.7, 3: 29.4, 4: 2.67, 5: 14.03, 6: 1.78, 7: 2.9, 8: 0.89, 10: 1.56},
    "ERP": {0: 2.7, 1: 8.11, 2: 10.81, 3: 29.73, 4: 21.62, 5: 16.22, 7: 10.81},
    "게임": {0: 13.04, 2: 13.04, 3: 43.48, 5: 30.43},
    "백엔드": {0: 8.4, 1: 5.57, 2: 9.77, 3: 32.75, 4: 5.88, 5: 22.6, 6: 2.98, 7: 6.34, 8: 2.29, 9: 0.23, 10: 2.9, 12: 0.08, 15: 0.23},
}


def postings(spark):
    rows = [(duty, years, n) for duty, counts in COUNTS.items() for years, n in counts.items()]
    counted = spark.createDataFrame(rows, "duty string, career int, n int")
    return counted.select("duty", "career", F.explode(F.sequence(F.lit(1), "n")).alias("id"))


def test_career_ratio(spark):
    got = {(r.category, r.career): (r["count"], r.ratio) for r in A.career_ratio(postings(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(d, y): n for d, c in COUNTS.items() for y, n in c.items()}
    for duty, shares in RATIOS.items():
        assert {y: got[duty, y][1] for y in shares} == shares


def test_career_summary(spark):
    got = {r.category: r for r in A.career_summary(A.career_counts(postings(spark))).collect()}
    ai, erp = got["AI"], got["ERP"]
    assert (ai.first_career, ai.first_count, ai.second_career, ai.second_count, ai.min_career) == (3, 132, 0, 90, 0)
    assert (erp.first_career, erp.first_count, erp.second_career, erp.second_count, erp.min_career) == (3, 11, 4, 8, 0)


def test_text_lines(spark):
    got = {r.category: r.lines for r in A.group_to_text_lines(A.career_ratio(postings(spark))).collect()}
    assert got["AI"].split("\n") == [
        "- 신입사원: 20.04%", "- 1년차: 10.02%", "- 2년차: 16.7%", "- 3년차: 29.4%", "- 4년차: 2.67%",
        "- 5년차: 14.03%", "- 6년차: 1.78%", "- 7년차: 2.9%", "- 8년차: 0.89%", "- 10년차: 1.56%",
    ]


def test_label_term_counts(spark):
    rows = [("B-LANG", "solidity"), ("B-LANG", "javas,java,jdk"), ("B-LANG", None), ("B-TOOL", ""), ("B-TOOL", "a,b")]
    got = A.label_term_counts(spark.createDataFrame(rows, "ner_label string, synonym string")).collect()
    assert {r.ner_label: r.total_count for r in got} == {"B-LANG": 2 + 4 + 1, "B-TOOL": 1 + 3}
