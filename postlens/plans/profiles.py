"""Profile tables: validation and the shapes the report operators take."""

from pyspark.sql import Column, DataFrame, functions as F

from postlens import constants as K

# --- fixed values: profile column of each category ---
PROFILE_LISTS = {"it_language": "languages", "framework": "frameworks", "library": "libraries", "tool": "devtools"}


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def sorted_profiles(profiles: DataFrame) -> DataFrame:
    """Lists come sorted."""
    return profiles.withColumns({c: F.sort_array(_list(c)) for c in [*PROFILE_LISTS.values(), "jobs"]})


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Adds ``problem``: null for a valid profile, else what is wrong with it."""
    lists = [_list(c) for c in PROFILE_LISTS.values()]
    everything = F.concat(*lists, _list("jobs"))
    return sorted_profiles(profiles).withColumn(
        "problem",
        F.when(F.size(everything) == 0, "nothing chosen")
        .when(F.size(_list("jobs")) == 0, "no job")
        .when(F.size(_list("jobs")) > 1, "more than one job")
        .when(F.size(F.array_distinct(everything)) < F.size(everything), "chosen twice"),
    )


def valid_profiles(profiles: DataFrame) -> DataFrame:
    return validate_profiles(profiles).filter(F.col("problem").isNull()).drop("problem")


def rejected_profiles(profiles: DataFrame) -> DataFrame:
    return validate_profiles(profiles).filter(F.col("problem").isNotNull())


def profile_groups(profiles: DataFrame) -> DataFrame:
    """profile_id, duty, category and ``owned_skills``: one row per job and category."""
    groups = F.array(*[F.named_struct(F.lit("category"), F.lit(c), F.lit("owned_skills"), F.sort_array(_list(n)))
                       for c, n in PROFILE_LISTS.items()])
    jobs = profiles.select("profile_id", F.explode("jobs").alias("duty"), groups.alias("_groups"))
    return jobs.select("profile_id", "duty", F.inline_outer("_groups"))


def profile_skills(profiles: DataFrame) -> DataFrame:
    """profile_id, duty, category, skill: one row per chosen skill."""
    return profile_groups(profiles).select("profile_id", "duty", "category", F.explode("owned_skills").alias("skill"))


def profile_texts(profiles: DataFrame) -> DataFrame:
    """profile_id and ``skills``: the chosen skills joined by spaces."""
    return profiles.select("profile_id", F.array_join(F.concat(*[_list(c) for c in PROFILE_LISTS.values()]), " ").alias("skills"))


def profile_keys(profiles: DataFrame) -> DataFrame:
    """The report cache key: duty and the four sorted lists, joined by ', '."""
    return profiles.select(
        "profile_id", F.get("jobs", F.lit(0)).alias("duty"),
        *[F.array_join(F.sort_array(_list(n)), ", ").alias(c) for c, n in PROFILE_LISTS.items()],
    )
