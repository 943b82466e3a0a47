"""Joins, lookups, filters on parameters."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlens import constants as K


def inner_join_by_id(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """N1"""
    return left.join(right, on, "inner")


def one_per_key(table: DataFrame, key: Column, *values: str) -> DataFrame:
    """(_key, values): of rows with equal keys the one whose values are greatest, in their order."""
    whole = F.struct(*values)
    rows = table.select(key.alias("_key"), whole.alias("_row")).filter("_key is not null").groupBy("_key").agg(F.max("_row").alias("_row"))
    return rows.select("_key", "_row.*")


def fill_blank_from_other(df: DataFrame, source: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """P2: '' and null cells take the value of the source row with the same id.

    Of source rows with equal ids the one with the greatest values, in the order of ``columns``, counts.
    """
    other = one_per_key(source, F.col(on), *columns).select(F.col("_key").alias(on), *[F.col(c).alias(f"_src_{c}") for c in columns])
    joined = df.join(other, on, "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_src_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def drop_incomplete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows with null or '' in a required column go."""
    for c in required:
        df = df.filter(F.col(c) != "")
    return df


def keep_listed(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership in a caller's list, or in the first column of a table."""
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(values.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def optional_equality(df: DataFrame, career: int | None = None, degree: int | None = None) -> DataFrame:
    """Career filters unless None; degree filters unless None or 0."""
    if career is not None:
        df = df.filter(F.col("career") == career)
    if degree:
        df = df.filter(F.col("degree") == degree)
    return df


def join_group_totals(counts: DataFrame, totals: DataFrame, on: str) -> DataFrame:
    """Detail rows with their group's total."""
    return counts.join(totals, on)


def lookup_with_default(df: DataFrame, table: DataFrame, key: Column, default: str, out: str) -> DataFrame:
    """``table`` has columns key, value (of equal keys the greatest value counts); a miss gives the default."""
    named = one_per_key(table, F.col("key"), "value").withColumnRenamed("value", "_value")
    return (
        df.join(named, key == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_value", F.lit(default)))
        .drop("_key", "_value")
    )


def new_names(df: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """Rows whose normalised name the base table lacks, duplicates kept."""
    known = base.select(F.trim(F.lower(name)).alias("_known")).distinct()
    return df.join(known, F.trim(F.lower(F.col(name))) == F.col("_known"), "left_anti")


def align_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two label counts side by side, a missing one as 0, with the difference."""
    a = left.select(on, F.col("count").alias("original_count"))
    b = right.select(on, F.col("count").alias("new_count"))
    both = a.join(b, on, "full_outer").fillna(0, ["original_count", "new_count"])
    return both.withColumn("difference", F.col("new_count") - F.col("original_count"))


def attach_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """The weight of (duty, category), null for a duty without weights."""
    return df.join(weights, ["duty", "category"], "left")


def share_of_table(df: DataFrame, by: str) -> DataFrame:
    """Count per group and its share of the whole table, from one scan and a scalar subquery."""
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count"))
    share = F.round(F.col("count") * F.lit(100.0) / total.scalar(), 2)
    return counts.withColumn("percentage", share)


def relabel_from_lookup(df: DataFrame, labels: DataFrame, key: str, label: str, outside: str = K.OUTSIDE) -> DataFrame:
    """Rows labelled outside take a label from (key, new_label); the others and misses stay.

    Of equal keys the greatest label counts.
    """
    named = one_per_key(labels, F.col(key), "new_label").withColumnRenamed("new_label", "_new")
    return (
        df.join(named, F.col(key) == F.col("_key"), "left")
        .withColumn(label, F.when(F.col(label) == outside, F.coalesce("_new", F.lit(outside))).otherwise(F.col(label)))
        .drop("_key", "_new")
    )


def contains_element_join(sets: DataFrame, ranked: DataFrame, on: Sequence[str], strict_like: bool = False) -> DataFrame:
    """Sets (``skill``, a ', '-joined text) with the ranked skills (``rskill``) they hold.

    The default matches whole elements. ``strict_like`` matches without regard to case and
    also a word suffix of an element ('native' in 'react native'), which is what the three
    patterns 'x,%', '% x' and '% x,%' accept. Both are equi-joins on the exploded elements.
    """
    on = list(on)
    elements = F.split("skill", ", ")
    if strict_like:
        def suffixes(element):
            parts = F.split(F.lower(element), " ")
            return F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.array_join(F.slice(parts, i, F.size(parts)), " "),
            )

        elements = F.array_distinct(F.flatten(F.transform(elements, suffixes)))
        keyed = ranked.withColumn("_element", F.lower("rskill"))
    else:
        elements = F.array_distinct(elements)
        keyed = ranked.withColumn("_element", F.col("rskill"))
    return sets.withColumn("_element", F.explode(elements)).join(keyed, [*on, "_element"]).drop("_element")


def match_set_to_text(sets: DataFrame, texts: DataFrame, on: Sequence[str]) -> DataFrame:
    """P25: text of the first entry (by ``ord``) whose every part is a substring of the set, else ''.

    Entries (``key``, ``text``, ``ord``) belong to one request, so they meet its sets by the
    request columns ``on``.
    """
    on = list(on)
    entries = texts.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct("ord", F.split("key", ", ").alias("parts"), "text"))).alias("_entries")
    )
    fits = F.filter("_entries", lambda e: F.forall(e["parts"], lambda p: F.contains(F.col("skill"), p)))
    return (
        sets.join(entries, on, "left")
        .withColumn("text", F.coalesce(F.try_element_at(fits, F.lit(1))["text"], F.lit("")))
        .drop("_entries")
    )


def wildcard_match(requests: DataFrame, rows: DataFrame, on: str, columns: Sequence[str], order: str) -> DataFrame:
    """Per request, how many rows it matches and the lowest ``order`` among them.

    An empty request value matches every non-null row value. Instead of testing each row
    against each request of its ``on`` group, rows are first grouped once per pattern of
    empty values, so the join is on equality and meets one row per request.
    """
    columns = list(columns)
    masks = F.array(*[F.lit(m) for m in range(2 ** len(columns))])

    def masked(c, i, mask):
        return F.when(F.getbit(mask, F.lit(i)) == 1, F.lit("")).otherwise(F.col(c)).alias(c)

    # The pattern of a request's empty values; only patterns that occur are built for the rows.
    mask = sum((F.when(F.col(c) == "", F.lit(2 ** i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0))
    used = requests.select(mask.alias("_mask")).distinct()
    live = rows.na.drop(subset=columns).select(on, *columns, order)
    patterns = (
        live.withColumn("_mask", F.explode(masks)).join(used, "_mask", "left_semi")
        .select(on, "_mask", *[masked(c, i, F.col("_mask")) for i, c in enumerate(columns)], order)
        .groupBy(on, "_mask", *columns)
        .agg(F.count("*").alias("matches"), F.min(order).alias(f"first_{order}"))
    )
    return (
        requests.withColumn("_mask", mask)
        .join(patterns, [on, "_mask", *columns], "left")
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .drop("_mask")
    )


#: Keys with a larger share of the rows than one in so many are joined apart; there can't be more of them.
HOT_KEYS = 1_000


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of many rows with one row a key, also where a key holds any share of the rows.

    ``weight`` counts the rows of each key and doesn't come along. Keys with more than
    1 / ``HOT_KEYS`` of all are fewer than that, so their rows meet a broadcast table of proven
    size and stay where they are; the others are joined as usual.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(lookup.filter(F.col(weight) * HOT_KEYS > total))
    cold = lookup.filter(F.col(weight) * HOT_KEYS <= total)
    apart = rows.join(hot.drop(weight), key)
    others = rows.join(hot.select(key), key, "left_anti").join(cold.drop(weight), key, "left")
    return apart.unionByName(others)
