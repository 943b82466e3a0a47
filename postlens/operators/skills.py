"""Skill statistics, rankings, fit scores and skill-set suggestions.

Shapes used here:

* baskets: one row per posting, duty and category with the arrays ``required`` and
  ``preferred``; an array is no larger than the skill dictionary.
* stats: duty, category, skill, unit, probability, pre_probability (percent).
* profile skills: profile_id, duty, category, skill.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens import constants as K
from postlens.operators.joins import contains_element_join
from postlens.session import saved_copy


def skill_order(prefix: str = "") -> list[Column]:
    return [F.desc(prefix + "probability"), F.desc(prefix + "pre_probability"), F.asc(prefix + "skill")]


def baskets_from_rows(rows: DataFrame) -> DataFrame:
    """Posting-skill rows (id, duty, category, skill, required) to baskets."""
    def names(flag):
        return F.sort_array(F.collect_set(F.when(F.col("required") == flag, F.col("skill"))))

    return rows.groupBy("id", "duty", "category").agg(names(True).alias("required"), names(False).alias("preferred"))


def baskets_from_postings(postings: DataFrame, categories: Sequence[str] = K.CATEGORIES) -> DataFrame:
    """The categorised posting table (joined cells ``c`` and ``pre_c``) to baskets, one per duty."""
    def cell(c):
        return F.sort_array(F.array_distinct(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ", "), lambda t: t != "")))

    pairs = F.array(*[
        F.named_struct(F.lit("category"), F.lit(c), F.lit("required"), cell(c), F.lit("preferred"), cell("pre_" + c))
        for c in categories
    ])
    duties = postings.select("id", F.explode(F.split("duty", ", ")).alias("duty"), pairs.alias("_pairs"))
    rows = duties.select("id", "duty", F.inline_outer("_pairs"))
    return rows.filter((F.size("required") > 0) | (F.size("preferred") > 0))


def weighted_baskets(baskets: DataFrame) -> DataFrame:
    """Equal baskets of a duty and category folded into one row with their number ``n``.

    Copies of a posting, and the many postings that share a small skill set, collapse here
    before anything is exploded.
    """
    return baskets.groupBy("duty", "category", "required", "preferred").agg(F.count("*").alias("n"))


def _percent(n: Column) -> Column:
    return F.lit(100.0) * n / F.col("total_jobs")


def skill_support(baskets: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of a duty's postings that name a skill as required and as preferred, unit 1.

    ``totals`` has duty and total_jobs.
    """
    flagged = F.transform(
        F.array_union("required", "preferred"),
        lambda s: F.struct(
            s.alias("skill"), F.array_contains("required", s).alias("req"), F.array_contains("preferred", s).alias("pre")
        ),
    )
    counts = (
        weighted_baskets(baskets)
        .select("duty", "category", "n", F.inline(flagged))
        .groupBy("duty", "category", "skill")
        .agg(
            F.sum(F.when(F.col("req"), F.col("n")).otherwise(0)).alias("_req"),
            F.sum(F.when(F.col("pre"), F.col("n")).otherwise(0)).alias("_pre"),
        )
    )
    return counts.join(totals, "duty").select(
        "duty", "category", "skill", F.lit(1).alias("unit"),
        _percent(F.col("_req")).alias("probability"), _percent(F.col("_pre")).alias("pre_probability"),
    )


def _sets_of_three(rows: DataFrame, items: str, keep: Sequence[str]) -> DataFrame:
    """All 3-element subsets of the sorted array, one row each as ``triple``.

    One element after the other is exploded with what follows it, so a row never holds more
    than one array of the basket's length, and each stage streams.
    """
    keep = list(keep)
    first = rows.select(*keep, F.posexplode(items).alias("_i", "_a"), F.col(items).alias("_all"))
    first = first.withColumn("_rest", F.slice("_all", F.col("_i") + 2, F.size("_all"))).filter(F.size("_rest") > 1)
    second = first.select(*keep, "_a", F.posexplode("_rest").alias("_j", "_b"), "_rest")
    second = second.withColumn("_last", F.slice("_rest", F.col("_j") + 2, F.size("_rest")))
    return second.select(*keep, "_a", "_b", F.explode("_last").alias("_c")).select(*keep, F.concat_ws(", ", "_a", "_b", "_c").alias("triple"))


def _sets_of_two(rows: DataFrame, items: str, keep: Sequence[str]) -> DataFrame:
    """All pairs ``_a`` < ``_b`` of the sorted array, one row each."""
    first = rows.select(*keep, F.posexplode(items).alias("_i", "_a"), F.col(items).alias("_all"))
    return first.select(*keep, "_a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("_b"))


def frequent_triples(baskets: DataFrame, totals: DataFrame, min_support: float) -> DataFrame:
    """(duty, category, req, pre, triple): the triples of each basket all of whose pairs have the least support.

    ``baskets`` has sorted ``items`` and the weights req and pre. Pairs are counted first. A basket
    is then projected on each of its skills, that is on the later skills that make a frequent pair
    with it, and only there are pairs put to triples, of which the third pair must be frequent,
    too. A triple with the least support is never lost, as no pair of it is rarer than it.
    """
    weights = ["duty", "category", "req", "pre"]
    numbered = saved_copy(baskets.select(*weights, "items").withColumn("_basket", F.monotonically_increasing_id()), "baskets")
    pairs = _sets_of_two(numbered, "items", ["_basket", *weights])
    pair = ["duty", "category", "_a", "_b"]
    frequent = saved_copy(
        pairs.groupBy(*pair).agg(F.sum("req").alias("_n")).join(totals, "duty")
        .filter(_percent(F.col("_n")) >= min_support).select(*pair), "frequent-pairs",
    )
    kept = pairs.join(frequent, pair, "left_semi")
    projected = kept.groupBy("_basket", *weights, "_a").agg(F.sort_array(F.collect_list("_b")).alias("_later")).filter(F.size("_later") > 1)
    later = _sets_of_two(projected.withColumnRenamed("_a", "_first"), "_later", ["_first", *weights])
    return later.join(frequent, pair, "left_semi").select(*weights, F.concat_ws(", ", "_first", "_a", "_b").alias("triple"))


def skill_set_support(baskets: DataFrame, totals: DataFrame, min_support: float = 0.0) -> DataFrame:
    """The same shares for 3-skill sets, unit 3, members sorted and joined by ', '.

    Exact: no basket is cut. Sets under ``min_support`` percent (of the required share) are
    not reported; skills and then pairs under it cannot be part of a reported set and are taken
    out before any triple is made, see ``frequent_triples``.
    Triples are built from distinct baskets only, weighted with the number of postings.
    """
    zero, n = F.lit(0).cast("long"), F.col("n")
    sides = F.array(
        F.named_struct(F.lit("items"), F.col("required"), F.lit("req"), n, F.lit("pre"), zero),
        F.named_struct(F.lit("items"), F.col("preferred"), F.lit("req"), zero, F.lit("pre"), n),
    )
    both = (
        weighted_baskets(baskets).select("duty", "category", F.inline_outer(sides)).filter(F.size("items") > 2)
        .groupBy("duty", "category", "items").agg(F.sum("req").alias("req"), F.sum("pre").alias("pre"))
    )
    if min_support > 0:
        frequent = (
            skill_support(baskets, totals).filter(F.col("probability") >= min_support)
            .groupBy("duty", "category").agg(F.collect_set("skill").alias("_keep"))
        )
        both = both.join(frequent, ["duty", "category"]).withColumn("items", F.array_intersect("items", "_keep")).drop("_keep")
        triples = frequent_triples(both, totals, min_support)
    else:
        triples = _sets_of_three(both, "items", ["duty", "category", "req", "pre"])
    counts = (
        triples.groupBy("duty", "category", F.col("triple").alias("skill"))
        .agg(F.sum("req").alias("_req"), F.sum("pre").alias("_pre"))
    )
    stats = counts.join(totals, "duty").select(
        "duty", "category", "skill", F.lit(3).alias("unit"),
        _percent(F.col("_req")).alias("probability"), _percent(F.col("_pre")).alias("pre_probability"),
    )
    return stats.filter(F.col("probability") >= min_support)


def rank_skills(stats: DataFrame) -> DataFrame:
    """RANK per duty and category; one row per dictionary skill and duty goes in."""
    order = Window.partitionBy("duty", "category").orderBy(*skill_order())
    return stats.filter("unit = 1").withColumn("rank", F.rank().over(order))


def limit_top_skills(ranked: DataFrame, n: int = 2) -> DataFrame:
    """The best n skills of one duty and category."""
    return ranked.orderBy("rank").limit(n)


def top_skills(stats: DataFrame, n: int = 2) -> DataFrame:
    """O5 for all duties and categories at once."""
    return rank_skills(stats).filter(F.col("rank") <= n)


def rank_neighbourhood(ranked: DataFrame, profile_skills: DataFrame, profiles: DataFrame,
                       top: int = 5, above: int = 3) -> DataFrame:
    """Per profile the ranks 1..top of its duty, and each owned skill with the ranks above it.

    ``profiles`` has profile_id and duty; the result has an ``owned`` flag.
    """
    keys = ["duty", "category"]
    own = profile_skills.join(ranked.select(*keys, "skill", "rank"), [*keys, "skill"])
    wanted = own.select(
        "profile_id", *keys, F.explode(F.sequence(F.col("rank") - above, F.col("rank"))).alias("rank")
    )
    groups = profiles.select("profile_id", "duty").join(ranked.select(*keys).distinct(), "duty")
    head = groups.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(top))))
    ranks = head.unionByName(wanted.select(*head.columns)).distinct()
    rows = ranks.join(ranked, [*keys, "rank"])
    marks = profile_skills.select("profile_id", *keys, "skill").distinct().withColumn("_own", F.lit(True))
    return rows.join(marks, ["profile_id", *keys, "skill"], "left").withColumn(
        "owned", F.coalesce("_own", F.lit(False))
    ).drop("_own")


def rank_gap_marker(rows: DataFrame) -> DataFrame:
    """Flag rows whose rank is more than one above the previous of the profile and category."""
    order = Window.partitionBy("profile_id", "duty", "category").orderBy("rank")
    return rows.withColumn("gap_before", F.coalesce(F.col("rank") > F.lag("rank").over(order) + 1, F.lit(False)))


def first_descriptions(rows: DataFrame, descriptions: str = "descriptions") -> DataFrame:
    """The first two items of the description list, '' where absent."""
    def item(i):
        return F.coalesce(F.get(descriptions, F.lit(i)), F.lit(""))

    return rows.withColumn("desc1", item(0)).withColumn("desc2", item(1))


def row_number_in_rank(candidates: DataFrame, by: Sequence[str], rank: str = "rrank") -> DataFrame:
    """Number of the set under its ranked skill, best first; equal shares in skill order."""
    order = Window.partitionBy(*by, rank).orderBy(*skill_order())
    return candidates.withColumn("rn", F.row_number().over(order))


def rank_selected_skills(stats: DataFrame, skills: DataFrame | Sequence[str], excluded_duty: str = K.LANGUAGE_DUTY) -> DataFrame:
    """RANK among the chosen skills only; shares of zero and one duty left out."""
    rows = stats.filter("unit = 1").filter((F.col("probability") != 0) & (F.col("duty") != excluded_duty))
    if isinstance(skills, DataFrame):
        rows = rows.join(skills.select("skill").distinct(), "skill", "left_semi")
    else:
        rows = rows.filter(F.col("skill").isin(list(skills)))
    order = Window.partitionBy("duty", "category").orderBy(*skill_order())
    return rows.withColumn("rank", F.rank().over(order))


def exclude_user_combinations(sets: DataFrame, owned: str = "owned_skills", skill: str = "skill") -> DataFrame:
    """Drop sets made wholly of owned skills; nothing owned drops nothing."""
    missing = F.size(F.array_except(F.split(skill, ", "), F.coalesce(owned, F.array().cast("array<string>"))))
    return sets.filter(missing > 0)


#: Sets of a key that lie in one array; larger keys are dealt to several rows.
BLOCK_SETS = 1_000


def open_sets(profiles: DataFrame, sets: DataFrame, keys: Sequence[str] = ("duty", "category"), owned: str = "owned_skills",
              block_sets: int = BLOCK_SETS) -> DataFrame:
    """P18 for many profiles: each profile row with the sets of its keys that it doesn't wholly own, as ``open``.

    The sets of a key are dealt by a hash to ``block``s of about ``block_sets``; a profile row comes
    once for each block of its key, so that no array grows with the key and no row per set is made.
    """
    distinct = sets.select(*keys, "skill").distinct()
    blocks = distinct.groupBy(*keys).agg(F.ceil(F.count("*") / block_sets).alias("_blocks"))
    member = F.struct("skill", F.split("skill", ", ").alias("members"))
    dealt = distinct.join(blocks, list(keys)).withColumn("block", F.pmod(F.xxhash64("skill"), F.col("_blocks")))
    listed = dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(member)).alias("_sets"))
    have = F.coalesce(F.col(owned), F.array().cast("array<string>"))
    left = F.filter("_sets", lambda s: F.size(F.array_except(s["members"], have)) > 0)
    return profiles.join(listed, list(keys)).withColumn("open", F.transform(left, lambda s: s["skill"])).drop("_sets")


def duty_fit_score(profile_skills: DataFrame, stats: DataFrame, weights: DataFrame,
                   excluded_duty: str = K.LANGUAGE_DUTY) -> DataFrame:
    """Weighted score of each duty for each profile, two decimals; null for a duty without weights.

    ``profile_skills`` needs profile_id and skill. One aggregation gives the summed share of
    each category; a category without skills adds a score of exactly zero.
    """
    rows = stats.filter("unit = 1").filter((F.col("probability") != 0) & (F.col("duty") != excluded_duty))
    sums = [F.sum(F.when(F.col("category") == c, F.col("probability")).otherwise(0.0)).alias(f"_p_{c}") for c in K.CATEGORIES]
    shares = (
        profile_skills.select("profile_id", "skill").distinct()
        .join(rows.select("duty", "category", "skill", "probability"), "skill")
        .groupBy("profile_id", "duty").agg(*sums)
    )
    wide = weights.groupBy("duty").agg(
        *[F.max(F.when(F.col("category") == c, F.col("weight"))).alias(f"_w_{c}") for c in K.CATEGORIES]
    )

    def part(c):
        p = F.col(f"_p_{c}")
        up = F.pow(F.lit(10.0), p / 100) - 1
        down = F.pow(F.lit(10.0), (100 - p) / 100) - 1
        return F.lit(100.0) * up / (up + down) * F.col(f"_w_{c}")

    score = sum((part(c) for c in K.CATEGORIES[1:]), part(K.CATEGORIES[0]))
    return shares.join(wide, "duty", "left").select("profile_id", "duty", F.round(score, 2).alias("score"))


def top_duties(scores: DataFrame, n: int = 3) -> DataFrame:
    """The best n duties per profile, equal scores in duty order."""
    order = Window.partitionBy("profile_id").orderBy(F.desc_nulls_last("score"), "duty")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def suggest_skill_sets(profiles: DataFrame, stats: DataFrame, limit: int = 2, probability: float = 1.0,
                       per_rank: int = 2, strict_like: bool = False, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Sets around the top skills of the profile's duty that the profile does not own yet.

    ``profiles`` has profile_id, duty, category and ``owned_skills`` (the skills chosen in that
    category, maybe empty); ``stats`` holds units 1 and 3. Per profile and category: sets with
    at least ``probability`` percent that hold a top skill; two for rank 1, then of the other
    ranks the first ``per_rank`` not shown yet.

    A profile, duty and category counts once. The candidates of a rank lie in blocks of
    ``block_sets`` in their order. A profile meets the first block, and only where too few of it are
    open the next ones, twice as many each time, so no array grows with a key and few sets meet a profile.
    """
    keys = ["duty", "category"]
    group = ["profile_id", *keys]
    ranked = top_skills(stats, limit).select(
        *keys, F.col("skill").alias("rskill"), F.col("probability").alias("rprobability"), F.col("rank").alias("rrank")
    )
    sets = stats.filter("unit = 3").filter(F.col("probability") >= probability).select(
        *keys, "skill", "probability", "pre_probability"
    )
    blocks = candidate_blocks(contains_element_join(sets, ranked, keys, strict_like), keys, block_sets)
    # the set of all ranked skills and two sets of rank 1 may be passed over
    met = first_open(profiles, blocks, keys, per_rank + 3)
    within = Window.partitionBy(*group)
    met = met.withColumn("_all", F.array_join(F.sort_array(F.collect_set(F.when(F.col("n_open") > 0, F.col("rskill"))).over(within)), ", "))
    rows = met.filter("s is not null").select(
        *group, "rrank", "rskill", "rprobability", "rn", "s.skill", "s.probability", "_all"
    ).filter(F.col("skill") != F.col("_all"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "rrank").orderBy("rn")))
    rows = rows.filter("rrank > 1 or _nth <= 2")
    fresh = rows.withColumn("_seen", F.min("rrank").over(Window.partitionBy(*group, "skill"))).filter(F.col("_seen") == F.col("rrank"))
    fresh = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "rrank").orderBy("rn"))).filter(F.col("_nth") <= per_rank)
    return fresh.select(
        *group, "skill", F.round("probability", 2).alias("probability"), "rskill", F.round("rprobability", 2).alias("rprobability"), "rrank", "rn",
    )


def candidate_blocks(joined: DataFrame, keys: Sequence[str], block_sets: int) -> DataFrame:
    """(keys, rrank, rskill, rprobability, block, last, sets): the sets of each ranked skill in W4's order.

    ``first`` in a set: no rank from 2 on shows it before this one does. ``last`` marks the last block.
    """
    again = Window.partitionBy(*keys, "skill")
    placed = row_number_in_rank(joined, keys).withColumn(
        "first", (F.col("rrank") == 1) | (F.col("rrank") == F.min(F.when(F.col("rrank") > 1, F.col("rrank"))).over(again))
    )
    dealt = placed.withColumn("block", F.floor((F.col("rn") - 1) / block_sets))
    one = F.struct(F.col("rn").alias("place"), "skill", "probability", "first", F.split("skill", ", ").alias("members"))
    listed = dealt.groupBy(*keys, "rrank", "rskill", "rprobability", "block").agg(F.sort_array(F.collect_list(one)).alias("sets"))
    of_rank = Window.partitionBy(*keys, "rrank")
    return saved_copy(listed.withColumn("last", F.col("block") == F.max("block").over(of_rank)), "set-blocks")


def first_open(profiles: DataFrame, blocks: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Per profile, key and rank the ``need`` first sets ``s`` that are open and first, with ``rn`` among all open ones.

    ``n_open`` counts the open sets of a met block; a block without a set to show gives one row with null ``s``.
    """
    group = ["profile_id", *keys]
    have = F.array_distinct(F.coalesce("owned_skills", F.array().cast("array<string>")))
    wanted = profiles.select(*group, have.alias("_owned")).dropDuplicates(group).join(blocks.select(*keys, "rrank").distinct(), list(keys))
    most = blocks.agg(F.max("block")).first()[0]
    met, begin, width = None, 0, 1
    while True:
        some = blocks.filter((F.col("block") >= begin) & (F.col("block") < begin + width))
        open_ones = F.filter("sets", lambda c: F.size(F.array_except(c["members"], F.col("_owned"))) > 0)
        now = wanted.join(some, [*keys, "rrank"]).withColumn("_open", open_ones)
        shown = F.filter(F.transform("_open", lambda c, i: F.struct(c.alias("s"), (i + 1).alias("nth"))), lambda n: n["s"]["first"])
        now = now.select(
            *group, "rrank", "rskill", "rprobability", "block", "last", F.size("_open").alias("n_open"), F.slice(shown, 1, need).alias("_shown")
        )
        begin, width = begin + width, 2 * width
        if most is None or begin > most:
            met = now if met is None else met.unionByName(now)
            break
        now = saved_copy(now, "open-sets")
        met = now if met is None else met.unionByName(now)
        short = met.groupBy(*group, "rrank").agg(F.sum(F.size("_shown")).alias("n"), F.max("last").alias("last")).filter((F.col("n") < need) & ~F.col("last"))
        wanted = wanted.join(short.select(*group, "rrank"), [*group, "rrank"], "left_semi")
        if wanted.isEmpty():
            break
    of_rank = Window.partitionBy(*group, "rrank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.coalesce(F.sum("n_open").over(of_rank), F.lit(0)))
    rows = met.select(*group, "rrank", "rskill", "rprobability", "n_open", "_before", F.explode_outer("_shown").alias("n"))
    rows = rows.select("*", "n.s", (F.col("_before") + F.col("n.nth")).cast("int").alias("rn")).drop("n", "_before")
    inside = Window.partitionBy(*group, "rrank").orderBy(F.asc_nulls_last("rn"))
    return rows.withColumn("_at", F.row_number().over(inside)).filter((F.col("_at") <= need) | F.col("s").isNull()).drop("_at")


def set_groups_report(suggested: DataFrame) -> DataFrame:
    """Suggested sets under the ranked skill that brought them, with their place from 0."""
    order = Window.partitionBy("profile_id", "duty", "category", "rskill").orderBy("rrank", "rn")
    return suggested.withColumn("place", F.row_number().over(order) - 1)
