"""Keyed tables: upserts, column updates, appends with running numbers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlens.functions.lists import update_list_path, update_list_text
from postlens.operators.sets import first_per_key, number_rows


def upsert_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """The last write per key; a change wins over the target row, then the greater version."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = [F.desc("_new")] + ([F.desc(version)] if version else [])
    return first_per_key(both, keys, order).drop("_new")


def update_column_from_table(
    target: DataFrame, source: DataFrame, on: str, column: str, value: str, source_order: str
) -> DataFrame:
    """Set ``column`` from the source row of the same key (the last by ``source_order``)."""
    last = first_per_key(source, [on], [F.desc(source_order)]).select(
        F.col(on).alias("_on"), F.col(value).alias("_value"), F.lit(True).alias("_hit")
    )
    return (
        target.join(last, F.col(on) == F.col("_on"), "left")
        .withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column)))
        .select(*target.columns)
    )


def clear_column(df: DataFrame, column: str) -> DataFrame:
    """S11"""
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def append_with_next_id(
    target: DataFrame, rows: DataFrame, order: Sequence[Column | str], seq: str = "seq"
) -> DataFrame:
    """The target and the new rows, these numbered from its greatest number + 1 (from 0 if empty)."""
    following = target.agg(F.coalesce(F.max(seq) + 1, F.lit(0)).cast("long"))
    numbered = number_rows(rows, order, seq, start=following.scalar())
    return target.unionByName(numbered.select(*target.columns))


def update_list_cell(
    target: DataFrame, source: DataFrame, on: str, column: str, path: str | None = None, text: str | None = None
) -> DataFrame:
    """S13 on a table: element 0 from ``path`` or element 1 from ``text`` of the keyed source.

    Of source rows with equal keys the greatest value counts.
    """
    value = path or text
    keyed = source.groupBy(F.col(on).alias("_on")).agg(F.max(F.col(value).cast("string")).alias("_value"))
    change = update_list_path if path else update_list_text
    assert isinstance(target.schema[column].dataType, T.ArrayType)
    return (
        target.join(keyed, F.col(on) == F.col("_on"), "left")
        .withColumn(column, F.when(F.col("_on").isNotNull(), change(column, F.col("_value"))).otherwise(F.col(column)))
        .select(*target.columns)
    )
