"""Distributions to the summary table: one row per duty with a list cell for each kind of summary."""

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.lists import update_list_text
from postlens.functions.text import percent_text
from postlens.operators.distribution import career_ratio, degree_distribution, group_to_text_lines, language_distribution
from postlens.operators.keyed import upsert_by_key


def _label_lines(shares: DataFrame, label: str) -> DataFrame:
    """(category, lines): '- label: share%' lines, the greatest share first, equal ones by label."""
    rows = shares.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("percentage")).alias("minus"), F.col(label).alias("label")))).alias("rows"))
    line = lambda r: F.concat(F.lit("- "), r["label"], F.lit(": "), percent_text(-r["minus"]))
    return rows.select("category", F.array_join(F.transform("rows", line), "\n").alias("lines"))


def duty_analysis(postings: DataFrame, table: DataFrame, duty: str = "duty", known=None) -> DataFrame:
    """E3 (A2, A3, A6, A12, S13, S9): the table (duty, language, career, degree: lists) with new texts as element 1.

    A duty the table has keeps element 0 of each list (the picture's path); a duty it lacks gets
    lists of the text alone; duties without postings stay as they are.
    """
    parts = {
        "language": _label_lines(language_distribution(postings, column=duty, known=known), "language_required"),
        "career": group_to_text_lines(career_ratio(postings, column=duty, known=known)),
        "degree": _label_lines(degree_distribution(postings, column=duty, known=known), "degree_required"),
    }
    texts = None
    for name, lines in parts.items():
        one = lines.select(F.col("category").alias("duty"), F.col("lines").alias(f"_{name}"))
        texts = one if texts is None else texts.join(one, "duty", "full_outer")
    joined = texts.join(table, "duty", "left")
    changes = joined.select("duty", *[_with_text(F.col(name), F.col(f"_{name}")).alias(name) for name in parts])
    return upsert_by_key(table.select("duty", *parts), changes, ["duty"])


def _with_text(cell: Column, text: Column) -> Column:
    """The list with the text as element 1; no text leaves it, no list becomes one."""
    return F.when(text.isNull(), cell).otherwise(update_list_text(F.coalesce(cell, F.array().cast("array<string>")), text))
