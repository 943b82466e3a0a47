"""What one task holds doesn't grow with the tables."""

import pytest

from catalog import QUERIES, q_sources, views
from postlens.sources import json_docs

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["j02_flatten_posting_json_b", "j03_rejected_rows"])
def test_large_tables_go_to_more_tasks(spark, monkeypatch, query):
    plain = sorted(map(str, QUERIES[query](spark, FOLDER).collect()))
    monkeypatch.setattr(views, "TASK_BYTES", 1 << 13)
    tasks = views.stored_bytes(spark, f"{FOLDER}/lineitem.parquet") >> 13
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = views.v2_skill_lists(spark, FOLDER)
    assert "hashpartitioning(l_orderkey#" in (plan := lists._jdf.queryExecution().executedPlan().toString()) and f", {tasks})" in plan
    assert sorted(map(str, QUERIES[query](spark, FOLDER).collect())) == plain


def test_small_tables_keep_the_sessions_tasks(spark):
    orders = views.table(spark, FOLDER, "orders")
    assert views.spread(orders, "o_orderkey", FOLDER, "lineitem") is orders


def test_diverted_rows_are_not_sorted(spark):
    from postlens.session import scratch_path

    rows = q_sources.raw_a(spark, FOLDER)
    setting, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    seen = []
    writer = type(rows.write)
    plain = writer.parquet
    try:
        writer.parquet = lambda self, path, *a, **k: seen.append(spark.conf.get(setting)) or plain(self, path, *a, **k)
        kept, rejected = json_docs.divert_bad_json(rows, "jobPosition", scratch_path(spark, "json-rows"))
    finally:
        writer.parquet = plain
    assert seen == ["2"] and spark.conf.get(setting) == before
    assert kept.count() + rejected.count() == rows.count() and rejected.filter("reason is null").count() == 0
