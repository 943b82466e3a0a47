import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import sharding as S
from postlens.llm.queries import QUERIES
from postlens.session import scratch_path
from tests.llm.helpers import frame, odd_documents


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 4), (1, 40, 20), (30, 2, 31), (12, 12, 12), (0, 9, 3), (6, 0, 2)])
def test_draws_follow_the_law(good, bad, drawn):
    rng, n = np.random.default_rng(3), 20_000
    seen = Counter(S.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(drawn + 1):
        want = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) if drawn - k <= bad else 0
        assert abs(seen[k] / n - want) <= 5 * math.sqrt(want * (1 - want) / n) + 1e-4 * (want > 0), k


def test_draws_from_very_large_populations():
    rng, good, bad, drawn = np.random.default_rng(1), 10**11, 3 * 10**11, 5 * 10**10
    got = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(300)], float)
    mean = drawn / 4
    deviation = math.sqrt(drawn * 0.25 * 0.75 * (good + bad - drawn) / (good + bad - 1))
    assert abs(got.mean() - mean) < 5 * deviation / math.sqrt(300) and 0.8 < got.std() / deviation < 1.2


def test_matrix_has_the_sizes_of_partitions_and_shards():
    sizes, shards = [0, 17, 3, 0, 250, 31, 1], S.shard_sizes(302, 5)
    assert sorted(shards) == [60, 60, 60, 61, 61]
    rows = [S.Matrix(sizes, shards, 9).row(k) for k in range(len(sizes))]
    assert [sum(r) for r in rows] == sizes and [sum(c) for c in zip(*rows)] == shards
    alone = S.Matrix(sizes, shards, 9)
    assert [alone.row(k) for k in reversed(range(len(sizes)))] == rows[::-1]


def test_matrix_entries_follow_the_law():
    sizes, shards, n = [3, 4, 2, 3], [4, 4, 4], 8_000
    seen = Counter(S.Matrix(sizes, shards, seed).row(2)[1] for seed in range(n))
    for k in range(3):
        want = math.comb(4, k) * math.comb(8, 2 - k) / math.comb(12, 2)
        assert abs(seen[k] / n - want) < 5 * math.sqrt(want * (1 - want) / n)


def check(rows, n, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == n and max(sizes.values(), default=0) - min((sizes[k] for k in range(shards)), default=0) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))


def test_odd_documents_keep_their_columns_and_values(spark):
    rows = odd_documents()
    docs = frame(spark, rows, extra=("shard", "slot", "_at", "_block", "_first", "_n")).repartition(5)
    out = S.uniform_shards(docs, 4)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    check(got, len(rows), 4)
    assert Counter((r["doc_id"], r["text"], r["_at"], r["_n"]) for r in got) == Counter((i, t, "clash", "clash") for i, t, _ in rows)


def test_empty_table_and_more_shards_than_rows(spark):
    assert S.uniform_shards(frame(spark, []), 4).collect() == []
    got = S.uniform_shards(frame(spark, [(1, "a", "en"), (2, "b", "en")]), 7).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]


def test_blocks_give_the_same_law_of_slots(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    docs = spark.range(1_000).withColumnRenamed("id", "doc_id").repartition(7)
    check(S.uniform_shards(docs, 3).collect(), 1_000, 3)


def test_every_row_may_come_to_any_slot(spark):
    """Over many seeds each row stands in each slot equally often, and pairs of rows part as often as they should."""
    docs = spark.createDataFrame([(k,) for k in range(6)], "doc_id long").repartition(3)
    n, slots, together = 30, Counter(), 0
    for seed in range(n):
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.uniform_shards(docs, 2, seed).collect()}
        slots.update(got.items())
        together += got[0][0] == got[1][0]
    assert all(abs(slots[k, (s, p)] / n - 1 / 6) < 0.34 for k in range(6) for s in range(2) for p in range(3))
    assert abs(together / n - 2 / 5) < 0.45


def test_the_same_seed_gives_the_same_result(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    one, two, other = (sorted(tuple(r) for r in S.uniform_shards(docs, 3, seed).collect()) for seed in (5, 5, 6))
    assert one == two != other


def test_shards_as_files(spark):
    docs = spark.range(300).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(F.lit("t"), "doc_id"))
    path = scratch_path(spark, "shards")
    dealt = S.uniform_shards(docs, 3)
    S.write_shards(dealt, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(tuple, dealt.select("doc_id", "text", "shard", "slot").collect()))


def test_query_against_a_plain_reading(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_sharding"](spark, folder).collect()
    check(got, len(docs), 40)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len(t) + 16, zlib.crc32(t), "rows", None) for i, t in docs.items()}
