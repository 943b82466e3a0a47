"""Operator 11: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn before any row moves: the matrix
with the partition sizes as row sums and the shard sizes as column sums, under the law that a
uniform permutation of all rows would give it. It is drawn by halving: a range of partitions and
the rows of each shard that come from it are split between the two halves of the range. The draw
of a range is seeded by the range, so every task works out its own row of the matrix from the
partition sizes alone, and a task that runs again finds the same row. A partition then deals its
rows by a permutation of its shard numbers, the rows are exchanged, and each shard is permuted
again.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.common import free_name, prepare, stored

LAW = "rows"
#: Source partitions at most; more are read several to a task. It bounds what every task is told: 512 KB.
SOURCE_PARTITIONS = 65_536
#: Rows of a shard that are ordered in one task, about.
BLOCK_ROWS = 100_000
#: Standard deviations on either side of the mode that a draw looks at; beyond lies less than 1e-30.
REACH = 12


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that add up to ``rows`` and are at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among ``drawn`` without replacement, for populations of any size.

    The law is inverted around its mode, where it is built up from the ratios of neighbours.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    reach = int(REACH * (drawn * share * (1 - share) * (total - drawn) / (total - 1)) ** 0.5) + REACH * REACH
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(step)))
    odds = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(odds, rng.random() * odds[-1], "right"))


def split(rng: np.random.Generator, counts: list[int], drawn: int) -> list[int]:
    """How many of each kind are among ``drawn`` of all, without replacement."""
    left, out = sum(counts), []
    for n in counts:
        left -= n
        out.append(hypergeometric(rng, n, left, drawn))
        drawn -= out[-1]
    return out


class Matrix:
    """The rows of a communication matrix, worked out one at a time."""

    def __init__(self, sizes: list[int], shards: list[int], seed: int):
        self.before = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
        self.shards, self.seed = shards, seed
        self.of_range = lru_cache(4_096)(self._of_range)

    def _of_range(self, low: int, high: int) -> tuple[list[int], list[int]]:
        """The shards' counts of the two halves of the partitions [low, high)."""
        whole = self._counts(low, high)
        middle = (low + high) // 2
        rng = np.random.default_rng([self.seed, low, high])
        left = split(rng, whole, int(self.before[middle] - self.before[low]))
        return left, [a - b for a, b in zip(whole, left)]

    def _counts(self, low: int, high: int) -> list[int]:
        first, last = 0, len(self.before) - 1
        counts = self.shards
        while (first, last) != (low, high):
            middle = (first + last) // 2
            left, right = self.of_range(first, last)
            first, last, counts = (first, middle, left) if high <= middle else (middle, last, right)
        return counts

    def row(self, part: int) -> list[int]:
        return self._counts(part, part + 1)


def uniform_key(seed: int, place: Column) -> Column:
    """A 64-bit key for each place; different places have different keys."""
    return F.xxhash64(F.lit(seed).cast("long"), place)


def uniform_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Every row with ``shard`` (0 to ``shards`` - 1) and ``slot``, its place in the shard from 0 on.

    Shard sizes are at most one apart. All ways to fill the slots are equally likely over the
    seeds; for one seed the result depends on the seed and on the place of each row in the table.
    All columns stay (columns of the two names are replaced) and no value of a row is looked at,
    so nulls, empty and long texts, ties, equal texts and repeated rows are dealt like any others.
    An empty table gives no rows; shards beyond the number of rows stay empty.

    The rows are written once, which fixes their places for tasks that run again, and shuffled
    once, to (shard, block of keys). Blocks are cut by random keys, so no task holds a shard.
    """
    prepare(docs)
    own = docs.drop("shard", "slot")
    at, block, first, n = (free_name(own, k) for k in ("at", "block", "first", "n"))
    placed = stored(own.coalesce(SOURCE_PARTITIONS).withColumn(at, F.monotonically_increasing_id()), "shard-rows")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright(at, 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    parts = [sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)]
    total = sum(parts)
    targets = shard_sizes(total, shards)
    blocks = -(-targets[0] // BLOCK_ROWS) or 1

    @F.pandas_udf("int")
    def dealt(places: pd.Series) -> pd.Series:
        """The shard of each place: entry ``row`` of its partition's permutation of shard numbers."""
        where = places.to_numpy()
        out = np.empty(len(where), np.int32)
        part = where >> 33
        for k in np.unique(part).tolist():
            some = part == k
            out[some] = permutation(k)[where[some] & ((1 << 33) - 1)]
        return pd.Series(out)

    known: dict = {}

    def permutation(part: int) -> np.ndarray:
        """The last partition's permutation is kept; rows come partition by partition."""
        if "matrix" not in known:
            known["matrix"] = Matrix(parts, targets, seed)
        if known.get("part") != part:
            known["part"] = part
            labels = np.repeat(np.arange(shards, dtype=np.int32), known["matrix"].row(part))
            known["labels"] = np.random.default_rng([seed, part]).permutation(labels)
        return known["labels"]

    high_bits = F.shiftrightunsigned(uniform_key(seed, F.col(at)), 33)
    block_of = F.shiftright(high_bits * blocks, 31).cast("int")
    sent = placed.withColumn("shard", dealt(at)).withColumn(block, block_of)
    inside = sent.withColumn("slot", F.row_number().over(Window.partitionBy("shard", block).orderBy(uniform_key(seed, F.col(at)))))
    counts = placed.select(at).withColumn("shard", dealt(at)).withColumn(block, block_of).groupBy("shard", block).agg(F.count("*").alias(n))
    offsets = stored(counts.withColumn(first, F.sum(n).over(Window.partitionBy("shard").orderBy(block)) - F.col(n)).drop(n), "shard-offsets")
    return inside.join(offsets, ["shard", block], "left").withColumn("slot", F.col("slot") + F.col(first) - 1).select(*own.columns, "shard", "slot")


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold runs of consecutive slots in order."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
