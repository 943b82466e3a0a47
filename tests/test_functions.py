"""Column functions on edge rows."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postlens import schemas
from postlens.functions import html, lists as L, text as X, tokens as K
from postlens.sources import json_docs


def one_column(spark, values, kind, column):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r[0] for r in df.select(column("c").alias("x")).collect()]


def test_career_range(spark):
    values = ["경력 무관", "", None, "신입", "경력 3 ~ 5년", "3~7", "경력 4년 이상", "협의", "신입 또는 3~5"]
    got = [tuple(r) for r in one_column(spark, values, "string", X.career_range)]
    assert got == [(0, 100), (0, 100), (0, 100), (0, 1), (3, 5), (3, 7), (4, 4), (0, 100), (0, 1)]


def test_extract_region(spark):
    values = ["서울특별시 강남구", "전라북도 전주", "경상남도 창원", "재택 근무", "Tokyo", None, "경기도 성남시 서울대입구"]
    assert one_column(spark, values, "string", X.extract_region) == ["서울", "전북", "경남", "재택", "기타", "기타", "서울"]


def test_like_takes_values_literally(spark):
    values = ["100%", "100x", "a_b", "axb", "A_B", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r.c for r in df.filter(X.like_contains("c", "0%")).collect()] == ["100%"]
    assert [r.c for r in df.filter(X.like_contains("c", "a_b")).collect()] == ["a_b", "A_B"]


def test_urls(spark):
    assert one_column(spark, ["/a", "", None], "string", X.build_url) == ["https://career.programmers.co.kr/a", "URL 없음", "URL 없음"]
    assert one_column(spark, ["x/12/y9", "x", None], "string", lambda c: X.url_number(c, "first")) == ["12", None, None]
    assert one_column(spark, ["x/12/y9", "x", None], "string", X.url_number) == ["9", None, None]


def test_split_functions(spark):
    assert one_column(spark, ["1. a\n\n 2. b. c \nplain"], "string", X.split_numbered_lines) == [["a", "b. c", "plain"]]
    assert one_column(spark, ["- a 3.5 x. b - c. "], "string", X.split_sentences_dash) == [["a 3.5 x", "b", "c"]]
    assert one_column(spark, ["1. a 2. b 10. c"], "string", X.split_numbered_inline) == [["a", "b", "c"]]


def test_percent_texts(spark):
    assert one_column(spark, [100.0, 9.1, 0.5], "double", X.percent_text) == ["100.0%", "9.1%", "0.5%"]
    assert one_column(spark, [100, 9], "int", X.percent_text_2) == ["100.00%", "9.00%"]


def test_lists(spark):
    cells = ["['a', 'b']", '["a, b"]', "[]", "a, b", None, "['it\\'s']"]
    assert one_column(spark, cells, "string", L.parse_list_literal) == [["a", "b"], ["a, b"], [], None, None, ["it's"]]
    assert [tuple(r) for r in one_column(spark, ["('a, b', 'B-X')", "x", None], "string", L.parse_tuple_literal)] == [
        ("a, b", "B-X"), (None, None), (None, None)]
    arrays = [[], ["p"], ["p", "t"], ["p", "t", "u"], None]
    path = lambda c: L.update_list_path(c, F.lit("n"))
    text = lambda c: L.update_list_text(c, F.lit("n"))
    assert one_column(spark, arrays, "array<string>", path) == [["n"], ["n"], ["n", "t"], ["n", "t", "u"], ["n"]]
    assert one_column(spark, arrays, "array<string>", text) == [["n"], ["p", "n"], ["p", "n"], ["p", "n"], ["n"]]
    assert one_column(spark, [[1, 25, 999], [], None], "array<int>", L.ids_to_names) == ["서버/백엔드, 웹 풀스택", "", None]


def degree(tokens):
    if "학사" in tokens or "대졸" in tokens:
        return 1
    for i, t in enumerate(tokens):
        if t in ("대학교", "대학") and any(x in ("졸업자", "졸업") for x in tokens[i + 1:i + 11]):
            return 1
    return 2 if "석사" in tokens or "박사" in tokens else 0


def test_degree_requirement(spark):
    rng = random.Random(1)
    words = ["대학교", "대학", "졸업자", "졸업", "석사", "박사", "학사"] + ["x"] * 40
    values = [[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(600)] + [[], ["대학"] + ["x"] * 9 + ["졸업"], ["대학"] + ["x"] * 10 + ["졸업"]]
    got = one_column(spark, values, "array<string>", K.degree_requirement)
    assert got == [degree(v) for v in values]
    assert one_column(spark, [None], "array<string>", K.degree_requirement) == [0]


def test_language_requirement(spark):
    values = [["x", "중국어", "영어"], ["일어"], [], None, ["x"]]
    assert one_column(spark, values, "array<string>", K.language_requirement) == [3, 2, None, None, None]


def test_tags(spark):
    df = spark.createDataFrame([(["react native", "go", "big data", ""], ["B-FRAMEWORKS", "B-LANGUAGES", "O", "O"])], "t array<string>, g array<string>")
    got = df.select(K.expand_multiword_tags("t", "g").alias("x")).first().x
    assert [tuple(r) for r in got] == [("react", "B-FRAMEWORKS"), ("native", "I-FRAMEWORKS"), ("go", "B-LANGUAGES"), ("big", "O"), ("data", "O"), ("", "O")]
    pieces = spark.createDataFrame([(["solid", "##ity", "c", "+", "##x"], [1, 2, 3]), (["##a", "b"], [5]), ([], [])], "p array<string>, l array<int>")
    got = [r[0] for r in pieces.select(K.mask_subwords("p", "l")).collect()]
    assert got == [[1, -100, 2, 3, -100], [-100, 5], []]
    assert one_column(spark, ["c + +", "c"], "string", lambda c: K.replicate_label(c, F.lit("B-LANG"))) == ["B-LANG B-LANG B-LANG", "B-LANG"]
    assert one_column(spark, [[1, 2, 3], [], [7]], "array<int>", lambda c: K.pad_labels(c, 2)) == [[1, 2], [0, 0], [7, 0]]


PAGE = """<div><h2>주요 업무</h2><p>intro</p><ul><li> build &amp; run </li><li>test<br>ship</li></ul>
<p><strong><b>[자격</b> 요건]</strong></p><ul><li>C++</li></ul><!-- <ul><li>no</li></ul> --><script>"<ul>"</script>
<h3>우대사항</h3><p>none</p></div>"""


def test_html(spark):
    got = one_column(spark, [PAGE, "", None, "<h3>우대사항</h3><ul><li>a</li><li>b</li></ul>"], "string", html.html_sections)
    assert tuple(got[0]) == ("build & runtestship", "C++", "")
    assert tuple(got[1]) == tuple(got[2]) == ("", "", "")
    assert tuple(got[3]) == ("", "", "ab")
    texts = ["<p> a </p><p>b &lt;c&gt;</p>", "plain  text ", None, "x<!-- c -->y", "a < b", "<script>var x='<p>';</script>z", "<li>one<li>two"]
    assert one_column(spark, texts, "string", html.strip_html) == ["ab <c>", "plain  text", None, "xy", "a < b", "z", "onetwo"]


def test_bad_rows_go_to_a_side_table(spark, tmp_path):
    texts = ['{"a": {"x": 1}}', '{"a": {}}', '{"a": null}', '{"b": 1}', '{"a": {"x"', "", " ", None, "[1]", '{"a": 3}', '{"a": {"x": 1}}']
    df = spark.createDataFrame([(i, t, "clash", True) for i, t in enumerate(texts)], "row int, text string, fault string, rejected boolean")
    kept, bad = json_docs.divert_bad_json(df, "a", str(tmp_path / "rows"))
    assert kept.columns == df.columns and bad.columns == [*df.columns, "reason"]
    assert sorted(r["row"] for r in kept.collect()) == [0, 10] == sorted(r["row"] for r in json_docs.skip_bad_json(df, "a").collect())
    assert {r["row"]: r["reason"] for r in bad.collect()} == {
        1: "empty root", 2: "no root", 3: "no root", 4: "not JSON", 5: "no text", 6: "no text", 7: "no text", 8: "no root", 9: "empty root"}
    none, nothing = json_docs.divert_bad_json(df.limit(0), "a", str(tmp_path / "none"))
    assert none.count() == nothing.count() == 0


def test_raw_documents(spark):
    texts = [
        '{"jobPosition": {"id": 1, "title": null, "technicalTags": [{"name": "c"}, {"x": 1}], "company": {"name": "n"}}}',
        '{"jobPosition": {}}', '{"other": 1}', '{"jobPosition": {"id": 2', "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row int, text string")
    served = {r.row: r for r in json_docs.serving_rows(df).collect()}
    assert set(served) == {0, 1, 2}
    assert (served[0].title, served[0].company, served[0].skills, served[0].deadline) == (None, "n", "c", "마감 기한 없음")
    assert (served[2].title, served[2].company, served[2].url, served[2].skills) == ("제목 없음", "회사명 없음", "URL 없음", "")
    assert [r.row for r in json_docs.skip_bad_json(df, "jobPosition").collect()] == [0]
    flat = json_docs.flatten_posting_json_a(df).collect()
    assert [(r.id, r.title, r.technicalTags, r.company_name) for r in flat] == [(1, "", "c", "n")]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab -.1\n", max_size=20), min_size=1, max_size=5))
def test_sentences_like_the_regular_expression(spark, values):
    want = [[p.strip() for p in re.split(r"(?<!\d)\.\s+|- ", v) if p.strip()] for v in values]
    assert one_column(spark, values, "string", X.split_sentences_dash) == want


def test_bad_page_takes_linear_time():
    import time

    from postlens.functions.html import _TextPieces

    page = "<div><b>x" * 40_000 + "</i>y" * 40_000
    start = time.perf_counter()
    assert len(_TextPieces(frozenset(("b",))).parse(page).pieces) == 80_000
    assert time.perf_counter() - start < 10


def test_synonym_file(spark):
    from postlens.session import scratch_path
    from postlens.sources import dictionaries as D

    rows = spark.createDataFrame([("tool", "git", 0, "git scm"), ("tool", "git", 1, "깃"), ("tool", "x", 0, "y")], "category string, canonical string, pos int, synonym string")
    path = scratch_path(spark, "synonyms")
    D.synonym_json(rows).select("value").write.text(path)
    assert sorted(map(tuple, D.scan_synonym_json(spark, path).collect())) == sorted(map(tuple, rows.collect()))
