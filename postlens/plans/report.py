"""Report parts for many profiles at once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from postlens import constants as K, schemas
from postlens.functions.lists import parse_list_literal
from postlens.functions.text import split_numbered_inline, split_numbered_lines, split_sentences_dash
from postlens.operators.joins import wildcard_match
from postlens.operators.keyed import append_with_next_id
from postlens.operators.recommend import recommend_postings_tfidf
from postlens.operators.sets import first_per_key
from postlens.operators.skills import (
    duty_fit_score, first_descriptions, rank_gap_marker, rank_neighbourhood, rank_skills,
    set_groups_report, suggest_skill_sets, top_duties,
)
from postlens.plans.profiles import profile_groups, profile_keys, profile_skills, profile_texts

CACHE_KEY = ["duty", *K.CATEGORIES]


def skill_rank_report(profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """C4: ranked skills around each profile's own in all categories of its duty."""
    ranked = rank_skills(stats)
    duties = profiles.select("profile_id", F.explode("jobs").alias("duty"))
    rows = rank_gap_marker(rank_neighbourhood(ranked, profile_skills(profiles), duties))
    if "description" in stats.columns:
        lists = F.coalesce(parse_list_literal("description"), F.array().cast("array<string>"))
        rows = first_descriptions(rows.withColumn("descriptions", lists)).drop("descriptions")
    return rows


def duty_summary_rows(profiles: DataFrame, summaries: DataFrame) -> DataFrame:
    """Path and numbered sentences of the career, degree and language cells of the chosen duties.

    ``summaries`` has duty and the three cells as list literals; a cell that is no list with
    two items gives no rows.
    """
    splitters: dict[str, Callable] = {
        "career": split_numbered_lines, "degree": split_sentences_dash, "language": split_numbered_inline,
    }
    # --- fixed values: what is replaced in a cell before it is read ---
    cleaning = {"career": ("/n", ""), "degree": ("\\", "/"), "language": ("\\", "/")}
    cells = F.array(*[
        F.named_struct(
            F.lit("part"), F.lit(part), F.lit("cell"),
            parse_list_literal(F.replace(F.col(part), F.lit(cleaning[part][0]), F.lit(cleaning[part][1]))),
        )
        for part in splitters
    ])
    rows = summaries.select("duty", F.inline_outer(cells)).filter(F.size("cell") >= 2)
    text = F.get("cell", F.lit(1))
    sentences = None
    for part, split in splitters.items():
        test = F.col("part") == part
        sentences = F.when(test, split(text)) if sentences is None else sentences.when(test, split(text))
    lines = rows.select(
        "duty", "part", F.get("cell", F.lit(0)).alias("path"), F.posexplode(sentences).alias("line_no", "line")
    )
    wanted = profiles.select("profile_id", F.explode("jobs").alias("duty"))
    return wanted.join(lines, "duty")


def cached_reports(profiles: DataFrame, cache: DataFrame, wildcard: bool = False) -> DataFrame:
    """For each profile the number (``seq``) of its stored report, null for a miss.

    By default all five key parts must be equal; with ``wildcard`` an empty list matches any
    stored one. Of several matches the lowest number counts.
    """
    keys = profile_keys(profiles)
    if wildcard:
        found = wildcard_match(keys, cache, "duty", list(K.CATEGORIES), "seq")
        return found.select("profile_id", *CACHE_KEY, F.col("first_seq").alias("seq"))
    stored = cache.groupBy(*CACHE_KEY).agg(F.min("seq").alias("seq"))
    return keys.join(stored, CACHE_KEY, "left").select("profile_id", *CACHE_KEY, "seq")


def store_missing_reports(profiles: DataFrame, cache: DataFrame, computed: DataFrame, stamp: str) -> DataFrame:
    """The cache with one appended row per missed key, numbered on from its last.

    ``computed`` has profile_id, improvement and conclusion.
    """
    misses = cached_reports(profiles, cache).filter(F.col("seq").isNull()).drop("seq")
    rows = misses.join(computed, "profile_id").withColumn("an_dt", F.lit(stamp))
    once = first_per_key(rows, CACHE_KEY, [F.asc("profile_id")])
    return append_with_next_id(cache, once, CACHE_KEY)


def profile_report(
    profiles: DataFrame, stats: DataFrame, weights: DataFrame, postings: DataFrame, summaries: DataFrame | None = None,
    set_probability: float = 1.0, stop_words: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """The parts of the report, each for all profiles.

    ``stats`` is read by several parts: persist it or read it from a stored table.
    """
    parts = {
        "ranks": skill_rank_report(profiles, stats),
        "sets": set_groups_report(suggest_skill_sets(
            profile_groups(profiles).filter(F.col("category") != "tool"), stats, probability=set_probability
        )),
        "duties": top_duties(duty_fit_score(profile_skills(profiles), stats, weights)),
        "postings": recommend_postings_tfidf(postings, profile_texts(profiles), stop_words=stop_words),
    }
    if summaries is not None:
        parts["summaries"] = duty_summary_rows(profiles, summaries)
    return parts


def empty_cache(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.CUSTOMIZED_ANALYSIS)
