"""Unions, differences, duplicates, sorting and numbering."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens import constants as K
from postlens.session import cut_lineage


def union_tagged(elements: DataFrame, duties: DataFrame, excluded: str = K.LANGUAGE_DUTY, tag: str = "job") -> DataFrame:
    """Category and name of both tables, the second tagged, one of its names left out."""
    tagged = duties.filter(F.col("name") != excluded).select(F.lit(tag).alias("category"), "name")
    return elements.select("category", "name").unionByName(tagged)


def union_missing_columns(*frames: DataFrame) -> DataFrame:
    """By column name, absent columns null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_replace_subset(df: DataFrame, condition: Column, replacement: DataFrame) -> DataFrame:
    """U4: rows that meet the condition go, the replacement rows come."""
    return df.filter(~F.coalesce(condition, F.lit(False))).unionByName(replacement)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """U5"""
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows per key in a total order.

    Spark cuts each partition to n rows per key before the shuffle, so a hot key costs a
    sort where its rows lie and no more than n rows per task afterwards.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def accumulate_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """All rows so far and today's, the latest of equal ones kept."""
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    return first_per_key(both, keys, [F.desc(stamp), F.desc("_part")]).drop("_part")


def labels_missing(df: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Distinct labels of one table that the other lacks."""
    return df.select(label).subtract(other.select(label))


def sort_custom_order(df: DataFrame, column: str, order: Sequence[str] = K.CATEGORY_ORDER) -> DataFrame:
    """O3: the position of the value in the list as ``ord``; values outside it are dropped."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn("ord", position).filter(F.col("ord") > 0).orderBy("ord")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "seq", start: int | Column = 0) -> DataFrame:
    """Consecutive numbers in a sort order, for frames of any size.

    The rows are range-sorted and written once, so that each partition has fixed rows; its
    offset is the number of rows in the partitions before it. No window sees more than one
    row per partition. Let the order end in a unique column: it settles ties, and rows with
    equal keys would all lie in one partition.
    """
    fixed = cut_lineage(df.orderBy(*order))
    local = F.monotonically_increasing_id()
    placed = fixed.withColumn("_part", F.shiftright(local, 33).cast("int")).withColumn(
        "_pos", local.bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_offset") + F.col("_pos") + first).cast("long"))
        .drop("_part", "_pos", "_offset")
    )


HASH_BUCKETS = 65_536


def hash_bucket(key: Column, seed: int) -> tuple[Column, Column]:
    """A seeded hash order: (bucket, full hash text)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), digest


def hash_positions(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """0-based position ``pos`` of each row in the seeded hash order, within ``by`` groups.

    Positions come from bucket counts plus the rank inside a bucket, so neither a group
    nor the table is ever sorted in one task. ``key`` identifies a row.
    """
    by = list(by)
    bucket, digest = hash_bucket(F.col(key), seed)
    rows = df.withColumn("_bucket", bucket).withColumn("_hash", digest)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    return (
        rows.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*by, "_bucket"])
        .withColumn("pos", (F.col("_offset") + F.col("_rn")).cast("long"))
        .drop("_bucket", "_hash", "_rn", "_offset")
    )
