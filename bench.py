"""Time the headline queries and print one JSON line.

Each query runs twice and the second run counts, so that the JVM's start-up and compilation
do not hide the work; every run computes and transfers the whole result into a sink.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from postlens.session import local_session  # noqa: E402

HEADLINE = [
    "a02_language_distribution", "a06_career_ratio", "a08_career_summary", "u02_union_per_category",
    "a13_skill_support", "a14_skill_set_support", "w01_rank_skills", "c02_duty_fit_score", "c03_suggest_skill_sets",
    "c04_skill_rank_report", "c01_recommend_postings_tfidf", "c05_filtered_vector_search", "c10_profile_report",
    "j01_flatten_posting_json_a", "h02_strip_html", "h03_dictionary_tokenize", "h04_replace_synonyms",
    "h06_classify_tokens_multi", "h08_normalize_multivalue_category", "e02_categorised_postings",
    "l01_l03_annotate_tokens", "l13_entity_report", "u05_drop_duplicate_rows", "s09_upsert_by_key",
    "x01_interest_over_time", "x02_ingest_postings_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
