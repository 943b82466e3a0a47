"""C5 over an index of cells: items lie by their nearest centroid, requests look into few cells.

Centroids are learned from a bounded sample; every item is indexed. A request scores the items of
its ``probes`` nearest cells exactly. By the triangle inequality of angles no item of a cell is
nearer than the request's angle to the centroid less the cell's radius, so an exact search goes on
with those other cells alone that can hold something better than the k-th score found so far.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.operators.nearest import nearest_items
from postlens.operators.sets import first_per_key
from postlens.session import saved_copy, scratch_path, ship_package

#: Items that centroids are learned from, the first ones by the hash of their id.
SAMPLE_ROWS = 20_000
MOST_CELLS = 1_024
ROUNDS = 10
#: Items of a cell that are written by one task, about.
BLOCK_ROWS = 20_000
#: Slack of a bound, beyond the rounding of scores and angles.
SLACK = 1e-6


@dataclass
class CellIndex:
    """``items`` with the columns cell and _n2 (squared norm), stored by cell; ``radius`` is each cell's greatest
    angle to its centroid, ``rows`` its number of items."""

    items: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def learn_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of ``cells`` groups of the sample by rounds of nearest centroid and mean; cells that lose all items stay where they are."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(moved[:, None], _unit(sums), centroids)
    return centroids


def norm2(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def build_cells(items: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """Index of all items (id, embedding and metadata), but those without a direction: null, empty or zero vectors.

    ``cells`` is the root of the number of items, at most ``MOST_CELLS``, where it isn't given.
    """
    ship_package(items.sparkSession)
    sized = items.withColumn("_n2", norm2("embedding")).filter("_n2 > 0")
    n = sized.count()
    cells = max(1, min(cells or int(n ** 0.5), MOST_CELLS, n))
    rows = sized.select("id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    sample = _unit(np.array([r["embedding"] for r in rows])) if rows else np.zeros((1, 1))
    centroids = learn_centroids(sample, min(cells, len(sample)))

    @F.pandas_udf("struct<cell:int,angle:double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        near = _unit(np.stack(vectors).astype(float)) @ centroids.T
        return pd.DataFrame({"cell": near.argmax(axis=1), "angle": np.arccos(np.clip(near.max(axis=1), -1, 1))})

    path = scratch_path(items.sparkSession, "cells")
    placed = sized.withColumn("_place", place("embedding")).select("*", "_place.angle", "_place.cell").drop("_place")
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (cells * BLOCK_ROWS))))).write.partitionBy("cell").parquet(path)
    stored = items.sparkSession.read.schema(placed.schema).parquet(path)
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
    return CellIndex(stored.drop("angle"), centroids, radius, size)


def cell_search(
    index: CellIndex, queries: DataFrame, condition: Callable[[Callable[[str], Column], Column], Column],
    k: int = 5, probes: int = 8, exact: bool = False, digits: int = 9,
) -> DataFrame:
    """(query_id, id, score, place), the k nearest items that meet each request's filters.

    ``queries`` has query_id (unique), vector and its own metadata; ``condition`` is as in
    ``filtered_vector_search`` and is tested inside the cells. Without ``exact`` only the
    ``probes`` nearest cells are looked into; with it the result is that of a comparison with all
    items. Requests without a direction find nothing.

    Items stay in their cells; requests are told to the tasks with the cells that they look into,
    see ``nearest``.
    """
    ship_package(queries.sparkSession)
    asked = saved_copy(queries.withColumn("_n2", norm2("vector")).filter("_n2 > 0"), "requests")
    centroids, radius, rows = index.centroids, index.radius, index.rows

    def angles(vectors: np.ndarray) -> np.ndarray:
        if not rows.any():
            return np.full((len(vectors), len(rows)), np.inf)
        angle = np.arccos(np.clip(vectors @ centroids.T, -1, 1))
        return np.where(rows > 0, angle, np.inf)  # empty cells come last

    def nearest(angle: np.ndarray) -> np.ndarray:
        near = np.zeros(angle.shape, bool)
        np.put_along_axis(near, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
        return near & np.isfinite(angle)

    def promising(requests: list, vectors: np.ndarray) -> np.ndarray:
        """Cells beyond the nearest that can hold a score as good as the k-th found."""
        angle = angles(vectors)
        bound = np.where(np.isfinite(angle), np.cos(np.maximum(angle - radius, 0)), -np.inf) + SLACK
        return ~nearest(angle) & (bound >= np.array([r["_least"] for r in requests])[:, None])

    found = nearest_items(index.items, asked, condition, k, digits, lambda requests, vectors: nearest(angles(vectors)))
    if exact:
        found = saved_copy(found, "nearest")
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("_least"))
        more = asked.join(least, "query_id", "left").withColumn("_least", F.coalesce("_least", F.lit(-2.0)))
        others = nearest_items(index.items, more, condition, k, digits, promising, ["_least"])
        found = first_per_key(found.unionByName(others), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def probes_for(index: CellIndex, recall: float = 0.95, k: int = 5, requests: int = 200) -> int:
    """The number of cells to look into so that a share ``recall`` of the ``k`` nearest items is found.

    Measured without filters for a sample of the indexed items, the first ones by the hash of
    their id, each compared with all items but itself.
    """
    some = index.items.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).orderBy(F.xxhash64("query_id"), "query_id").limit(requests)
    some = saved_copy(some, "sample")
    # Without the item itself k of the k + 1 nearest are left, or k + 1 where it isn't among them.
    found = cell_search(index, some, lambda item, request: F.lit(True), k + 1, exact=True).filter("id <> query_id")
    found = first_per_key(found, ["query_id"], [F.asc("place")], k)
    where = found.join(index.items.select("id", "cell"), "id").join(some, "query_id").select("vector", "cell").collect()
    if not where:
        return 1
    angle = np.where(index.rows > 0, -_unit(np.array([r["vector"] for r in where])) @ index.centroids.T, np.inf)
    own = angle[np.arange(len(where)), [r["cell"] for r in where]]
    ranks = np.sort((angle < own[:, None]).sum(axis=1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
