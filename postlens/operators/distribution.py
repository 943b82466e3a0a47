"""Per-duty distributions: counts, shares, summaries, text blocks.

Every operator scans the postings once. A posting counts once in each of its duties; the
duty string is exploded and rows are pre-aggregated where they lie, so a duty that holds
a third of the postings adds no more to the shuffle than a rare one.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens import constants as K
from postlens.functions.text import career_label, code_to_label, percent_text


def explode_duties(
    postings: DataFrame, column: str = "duty", out: str = "category", known: Sequence[str] | None = None, sep: str = ", "
) -> DataFrame:
    """One row per posting and duty, in place of one filtered copy per duty."""
    rows = postings.withColumn(out, F.explode(F.array_distinct(F.split(column, sep))))
    return rows.filter(F.col(out).isin(list(known))) if known else rows


def category_totals(postings: DataFrame, column: str = "duty", known: Sequence[str] | None = None) -> DataFrame:
    """A1"""
    rows = explode_duties(postings.select(column), column, known=known)
    return rows.groupBy("category").agg(F.count("*").alias("total_jobs"))


def label_distribution(
    postings: DataFrame, label: Column, name: str, column: str = "duty", known: Sequence[str] | None = None
) -> DataFrame:
    """Duty and label with count, duty total and percentage.

    Totals are a window over the counted rows (duties times labels), not a second scan.
    """
    rows = explode_duties(postings.select(column, label.alias(name)), column, known=known)
    counts = rows.groupBy("category", name).agg(F.count("*").alias("count"))
    return with_share(counts, "category", "count", "total_jobs", "percentage")


def with_share(counts: DataFrame, by: str, count: str, total: str, share: str) -> DataFrame:
    """Group total and share of already counted rows."""
    out = counts.withColumn(total, F.sum(count).over(Window.partitionBy(by)))
    return out.withColumn(share, F.round(F.lit(100.0) * F.col(count) / F.col(total), 2))


def language_distribution(postings: DataFrame, labels: Mapping[int, str] = K.LANGUAGE_LABELS,
                          default: str = K.NO_LANGUAGE_LABEL, column: str = "duty",
                          known: Sequence[str] | None = None) -> DataFrame:
    """A2"""
    return label_distribution(postings, code_to_label("language", labels, default), "language_required", column, known)


def degree_distribution(postings: DataFrame, labels: Mapping[int, str] = K.DEGREE_LABELS, column: str = "duty",
                        known: Sequence[str] | None = None) -> DataFrame:
    """A3"""
    return label_distribution(postings, code_to_label("degree", labels), "degree_required", column, known)


def overall_share(df: DataFrame, by: str, label: Column, name: str) -> DataFrame:
    """A4: share of each code in the whole table."""
    counts = df.groupBy(by).agg(F.count("*").alias("_count"))
    total = counts.agg(F.sum("_count")).scalar()
    return counts.select(label.alias(name), F.round(F.col("_count") * F.lit(100.0) / total, 2).alias("percentage"))


def career_counts(postings: DataFrame, column: str = "duty", known: Sequence[str] | None = None) -> DataFrame:
    """A5"""
    rows = explode_duties(postings.select(column, "career"), column, known=known)
    return rows.groupBy("category", "career").agg(F.count("*").alias("count"))


def career_ratio(postings: DataFrame, column: str = "duty", known: Sequence[str] | None = None) -> DataFrame:
    """A6"""
    return with_share(career_counts(postings, column, known), "category", "count", "total", "ratio").drop("total")


def raw_duty_career_counts(postings: DataFrame, column: str = "duty") -> DataFrame:
    """Grouped on the joined duty text."""
    return postings.groupBy(column, "career").agg(F.count("*").alias("count"))


def career_summary(counts: DataFrame) -> DataFrame:
    """Most frequent, second most frequent (ties: the lower year) and lowest year per duty."""
    order = Window.partitionBy("category").orderBy(F.desc("count"), "career")
    ranked = counts.withColumn("rn", F.row_number().over(order))

    def at(n, column):
        return F.max(F.when(F.col("rn") == n, F.col(column)))

    return ranked.groupBy("category").agg(
        at(1, "career").alias("first_career"), at(1, "count").alias("first_count"),
        at(2, "career").alias("second_career"), at(2, "count").alias("second_count"),
        F.min("career").alias("min_career"),
    )


def label_term_counts(elements: DataFrame, label: str = "ner_label", synonym: str = "synonym") -> DataFrame:
    """Per label the number of names and synonyms."""
    synonyms = F.when(F.coalesce(F.col(synonym), F.lit("")) == "", 0).otherwise(F.size(F.split(synonym, ",")))
    return elements.groupBy(label).agg(F.sum(F.lit(1) + synonyms).alias("total_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A10: frequency of the non-null values, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column)


def collect_group_rows(counted: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """The counted rows of each group as one sorted list."""
    return counted.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))


def group_to_text_lines(counted: DataFrame, by: str = "category", career: str = "career", ratio: str = "ratio") -> DataFrame:
    """One block of '- year: share%' lines per group, in the order of the years."""
    rows = collect_group_rows(counted, by, [career, ratio])
    line = lambda r: F.concat(F.lit("- "), career_label(r[career]), F.lit(": "), percent_text(r[ratio]))
    return rows.select(by, F.array_join(F.transform("rows", line), "\n").alias("lines"))


def count_lines(counted: DataFrame, by: str = "category", career: str = "career", count: str = "count") -> DataFrame:
    """One block of '- year: n' lines with counts per group."""
    rows = collect_group_rows(counted, by, [career, count])
    line = lambda r: F.concat(F.lit("- "), r[career].cast("string"), F.lit(K.YEAR_SUFFIX + ": "), r[count].cast("string"), F.lit("건"))
    return rows.select(by, F.array_join(F.transform("rows", line), "\n").alias("lines"))


def trend_extent(series: DataFrame, date: str, keywords: Sequence[str]) -> DataFrame:
    """Greatest value over the keyword columns and the middle date (row n div 2 in date order).

    The series has one row per date bucket; the date columns alone are collected in an array.
    """
    peak = F.greatest(*[F.coalesce(F.col(k), F.lit(0)) for k in keywords]) if len(keywords) > 1 else F.col(keywords[0])
    return series.agg(F.max(peak).alias("max_value"), F.sort_array(F.collect_list(date)).alias("_dates")).select(
        "max_value", F.get("_dates", F.floor(F.size("_dates") / 2).cast("int")).alias("middle_date")
    )
