"""Vector search over cells against a comparison with all items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import cells as C, recommend as R
from tools.check import canonical

FOLDER = "/root/testdata/sf0.01"


def tables(spark, rows, requests):
    items = spark.createDataFrame([(i, v, d) for i, v, d in rows], "id long, embedding array<float>, degree int")
    return items, spark.createDataFrame(requests, "query_id long, vector array<float>, degree int")


def clustered(seed, n, around=12, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(around, size)) * 3
    return (centres[rng.integers(0, around, n)] + rng.normal(size=(n, size))).astype("f4")


@pytest.mark.parametrize("cells,probes", [(None, 2), (1, 1), (40, 1)])
def test_exact_search_equals_all_items(spark, cells, probes):
    vectors = clustered(1, 600)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(vectors)]
    rows += [(1_000 + k, vectors[0].tolist(), 1) for k in range(300)]  # a third of all items lie at one point
    rows += [(2_000, [0.0] * 16, 1), (2_001, None, 1)]
    requests = [(k, v.tolist(), k % 4 % 3) for k, v in enumerate(clustered(2, 25))] + [(99, vectors[0].tolist(), None), (100, [0.0] * 16, 0)]
    items, asked = tables(spark, rows, requests)
    match = R.matches_filters(optional=["degree"])
    got = C.cell_search(C.build_cells(items, cells), asked, match, probes=probes, exact=True)
    want = R.filtered_vector_search(items.filter("id < 2000"), asked.filter("query_id <> 100"), match)
    assert canonical(got.toPandas()) == canonical(want.toPandas())


def test_large_cells_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 20)
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(clustered(3, 400, around=1))]
    items, asked = tables(spark, rows, [(k, v, 0) for k, v, _ in rows[:10]])
    index = C.build_cells(items, 3)
    assert index.rows.max() > 40
    got = C.cell_search(index, asked, R.matches_filters(), exact=True)
    assert canonical(got.toPandas()) == canonical(R.filtered_vector_search(items, asked, R.matches_filters()).toPandas())


def test_recall_of_the_chosen_number_of_probes(spark):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(clustered(4, 3_000))]
    items, asked = tables(spark, rows, rows[::100])
    index = C.build_cells(items)
    probes = C.probes_for(index)
    near, full = (set(map(tuple, df.select("query_id", "id").collect())) for df in (
        C.cell_search(index, asked, R.matches_filters(), probes=probes), R.filtered_vector_search(items, asked, R.matches_filters())))
    assert probes < len(index.centroids) / 2 and len(near & full) >= 0.9 * len(full)


def test_filters_hold_inside_cells(spark):
    rows = [(k, v.tolist(), k % 5) for k, v in enumerate(clustered(5, 300))]
    items, asked = tables(spark, rows, [(k, v, 3) for k, v, _ in rows[:20]])
    got = C.cell_search(C.build_cells(items), asked, R.matches_filters(equal=["degree"]), probes=4).select("id").collect()
    assert got and {r["id"] % 5 for r in got} == {3}


def test_empty_tables(spark):
    items, asked = tables(spark, [], [(1, [1.0, 0.0], 0)])
    assert C.cell_search(C.build_cells(items), asked, R.matches_filters()).collect() == []
    items, asked = tables(spark, [(1, [1.0, 0.0], 0)], [])
    assert C.cell_search(C.build_cells(items), asked, R.matches_filters(), exact=True).collect() == []


def test_requests_read_their_cells_only(spark):
    items = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = C.build_cells(items)
    plan = index.items.filter("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(cell#" in plan.split("PartitionFilters")[1][:120]


@pytest.mark.parametrize("limits", [{}, {"PASS_REQUESTS": 7, "CHUNK_SCORES": 40}])
def test_comparison_makes_no_rows_of_pairs(spark, monkeypatch, limits):
    """Against brute force, with copies, texts as ids and vectors without a direction; no pair of item and request is a row."""
    from postlens.operators import nearest as N

    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    vectors = clustered(7, 150)
    rows = [(f"i{k:03}", v.tolist(), k % 3) for k, v in enumerate(vectors)] + [(f"c{k:03}", vectors[0].tolist(), 1) for k in range(60)]
    rows += [("zero", [0.0] * 16, 1), ("none", None, 1), ("short", [1.0], 2)]
    items = spark.createDataFrame(rows, "id string, embedding array<float>, degree int").repartition(3)
    requests = [(k, v.tolist(), k % 3) for k, v in enumerate(clustered(8, 20))] + [(90, vectors[0].tolist(), None)]
    asked = spark.createDataFrame(requests, "query_id long, vector array<float>, degree int")
    got = R.filtered_vector_search(items, asked, R.matches_filters(optional=["degree"]), k=65)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        found.setdefault(r.query_id, []).append((r.id, r.score))
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    for q, vector, degree in requests:
        scored = [(i, round(float(unit(v) @ unit(vector)), 9) if v and len(v) == 16 and any(v) else None) for i, v, d in rows if not degree or d == degree]
        want = sorted(scored, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:65]
        assert [i for i, _ in found[q]] == [i for i, _ in want], q
        assert all(a == b or abs(a - b) < 2e-9 for (_, a), (_, b) in zip(found[q], want))
