"""A13, A14, W, O5, O6, C2, C3, C8: skill statistics, ranks, scores, sets."""

from pyspark.sql import functions as F

from catalog.q_joins import WEIGHTS_SQL, stats1, stats3
from catalog.registry import query
from catalog.views import V2_SETS_SQL, V2_SQL, V2_STATS_SQL, V7_SQL, WEIGHTS, v2_baskets, v2_cells, v2_totals, v7, with_ctes
from postlens.operators.sets import first_per_key
from postlens.operators import skills as S
from postlens.plans.profiles import profile_groups, profile_skills
from postlens.plans.report import skill_rank_report
from postlens.session import saved_copy
from postlens.sources.dictionaries import duty_weights

# Least share for sets, in percent: the stand-in shares lie between 0 and 0.2.
SET_SHARE = 0.03


def both_units(spark, folder):
    """Units 1 and 3 as a stored table, as the report jobs read them more than once."""
    return saved_copy(stats1(spark, folder).unionByName(stats3(spark, folder)), "skill_probability")


ROUNDED = "round(probability, 6) AS probability, round(pre_probability, 6) AS pre_probability"


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("probability", "pre_probability")})


@query("a13_skill_support", with_ctes(V2_STATS_SQL, body=f"SELECT duty, category, skill, unit, {ROUNDED} FROM stats1"))
def _(spark, folder):
    return rounded(stats1(spark, folder))


@query("a13_skill_support_of_cells", with_ctes(V2_STATS_SQL, body=f"SELECT duty, category, skill, unit, {ROUNDED} FROM stats1"))
def _(spark, folder):
    baskets = S.baskets_from_postings(v2_cells(spark, folder))
    return rounded(S.skill_support(baskets, v2_totals(spark, folder)))


@query("a14_skill_set_support", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body=f"SELECT duty, category, skill, unit, {ROUNDED} FROM stats3"))
def _(spark, folder):
    return rounded(stats3(spark, folder))


@query("a14_skill_set_support_pruned", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body=f"SELECT duty, category, skill, unit, {ROUNDED} FROM stats3 WHERE probability >= 0.03"))
def _(spark, folder):
    return rounded(stats3(spark, folder, SET_SHARE))


@query("w01_rank_skills", with_ctes(V2_STATS_SQL, body="SELECT duty, category, skill, rank FROM ranked"))
def _(spark, folder):
    return S.rank_skills(stats1(spark, folder)).select("duty", "category", "skill", "rank")


@query("o05_limit_top_skills", with_ctes(V2_STATS_SQL, body="""
SELECT skill, rank FROM ranked WHERE duty = '1-URGENT' AND category = 'framework' ORDER BY rank LIMIT 2"""))
def _(spark, folder):
    ranked = S.rank_skills(stats1(spark, folder)).filter("duty = '1-URGENT' AND category = 'framework'")
    return S.limit_top_skills(ranked).select("skill", "rank")


NEAR_SQL = """near AS (SELECT DISTINCT v.profile_id, r.duty, r.category, r.skill, r.rank, r.probability FROM v7 v JOIN ranked r ON v.duty = r.duty
  WHERE r.rank <= 5 OR EXISTS (SELECT 1 FROM own o JOIN ranked x ON o.duty = x.duty AND o.category = x.category AND o.skill = x.skill
    WHERE o.profile_id = v.profile_id AND o.category = r.category AND r.rank BETWEEN x.rank - 3 AND x.rank)),
marked AS (SELECT n.*, EXISTS (SELECT 1 FROM own o WHERE o.profile_id = n.profile_id AND o.category = n.category AND o.skill = n.skill) AS owned FROM near n)"""


@query("w02_rank_neighbourhood", with_ctes(V2_STATS_SQL, V7_SQL, NEAR_SQL, body="SELECT profile_id, duty, category, skill, rank, owned FROM marked"))
def _(spark, folder):
    profiles = v7(spark, folder)
    duties = profiles.select("profile_id", F.explode("jobs").alias("duty"))
    rows = S.rank_neighbourhood(S.rank_skills(stats1(spark, folder)), profile_skills(profiles), duties)
    return rows.select("profile_id", "duty", "category", "skill", "rank", "owned")


GAP_SQL = """SELECT profile_id, duty, category, skill, rank, owned, coalesce(rank > lag(rank) OVER (PARTITION BY profile_id, duty, category ORDER BY rank) + 1, false) AS gap_before,
  {extra} FROM marked"""


@query("w03_rank_gap_marker", with_ctes(V2_STATS_SQL, V7_SQL, NEAR_SQL, body=GAP_SQL.format(extra="skill || ' a' AS desc1, CASE WHEN category = 'tool' THEN '' ELSE 'b' END AS desc2")))
def _(spark, folder):
    text = F.concat(F.lit("['"), "skill", F.when(F.col("category") == "tool", " a']").otherwise(" a', 'b', 'c']"))
    stats = stats1(spark, folder).withColumn("description", text)
    return skill_rank_report(v7(spark, folder), stats).select(
        "profile_id", "duty", "category", "skill", "rank", "owned", "gap_before", "desc1", "desc2")


@query("c04_skill_rank_report", with_ctes(V2_STATS_SQL, V7_SQL, NEAR_SQL, body=GAP_SQL.format(extra="round(probability, 6) AS probability")))
def _(spark, folder):
    rows = skill_rank_report(v7(spark, folder), stats1(spark, folder))
    return rows.select("profile_id", "duty", "category", "skill", "rank", "owned", "gap_before", F.round("probability", 6).alias("probability"))


@query("w04_row_number_in_rank", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT s.duty, s.category, s.skill, r.skill AS rskill, r.rank AS rrank,
  CAST(row_number() OVER (PARTITION BY s.duty, s.category, r.rank ORDER BY s.probability DESC, s.pre_probability DESC, s.skill) AS INTEGER) AS rn
FROM stats3 s JOIN ranked r ON s.duty = r.duty AND s.category = r.category AND r.rank <= 2 AND list_contains(string_split(s.skill, ', '), r.skill)"""))
def _(spark, folder):
    keys = ["duty", "category"]
    ranked = S.top_skills(stats1(spark, folder)).select(*keys, F.col("skill").alias("rskill"), F.col("rank").alias("rrank"))
    joined = S.contains_element_join(stats3(spark, folder), ranked, keys)
    return S.row_number_in_rank(joined, keys).select(*keys, "skill", "rskill", "rrank", "rn")


@query("w05_rank_selected_skills", with_ctes(V2_STATS_SQL, body="""
SELECT duty, category, skill, CAST(rank() OVER (PARTITION BY duty, category ORDER BY probability DESC, pre_probability DESC, skill) AS INTEGER) AS rank
FROM stats1 WHERE duty <> '3-MEDIUM' AND probability <> 0 AND skill IN ('brand 1', 'brand 4', 'brand 5', 'brand 8', 'brand 9', 'brand 23')"""))
def _(spark, folder):
    chosen = [f"brand {n}" for n in (1, 4, 5, 8, 9, 23)]
    return S.rank_selected_skills(stats1(spark, folder), chosen, "3-MEDIUM").select("duty", "category", "skill", "rank")


SCORES_SQL = """sums AS (SELECT o.profile_id, s.duty, s.category, sum(s.probability) AS p FROM own o JOIN stats1 s ON o.skill = s.skill
  WHERE s.probability <> 0 AND s.duty <> '3-MEDIUM' GROUP BY ALL),
scores AS (SELECT profile_id, duty, CASE WHEN count(w.weight) = count(*) THEN round(sum(100 * (pow(10, p / 100) - 1) / ((pow(10, p / 100) - 1) + (pow(10, (100 - p) / 100) - 1)) * w.weight), 2) END AS score
  FROM sums LEFT JOIN weights w USING (duty, category) GROUP BY profile_id, duty)"""


@query("c02_duty_fit_score", with_ctes(V2_STATS_SQL, V7_SQL, WEIGHTS_SQL, SCORES_SQL, body="SELECT profile_id, duty, score FROM scores"))
def _(spark, folder):
    return fit_scores(spark, folder)


def fit_scores(spark, folder):
    return S.duty_fit_score(profile_skills(v7(spark, folder)), stats1(spark, folder), duty_weights(spark, WEIGHTS), "3-MEDIUM")


@query("o06_top_duties", with_ctes(V2_STATS_SQL, V7_SQL, WEIGHTS_SQL, SCORES_SQL, body="""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, duty) AS INTEGER) AS place FROM scores) WHERE place <= 3"""))
def _(spark, folder):
    return S.top_duties(fit_scores(spark, folder))


def suggest_ctes(limit: int = 2, per_rank: int = 2, strict: bool = False) -> str:
    ends = " OR len([x FOR x IN string_split(s.skill, ', ') IF ends_with(x, ' ' || r.skill)]) > 0" if strict else ""
    return f"""open AS (SELECT g.profile_id, s.duty, s.category, s.skill, s.probability, r.skill AS rskill, r.probability AS rprobability, r.rank AS rrank,
  CAST(row_number() OVER (PARTITION BY g.profile_id, s.duty, s.category, r.rank ORDER BY s.probability DESC, s.pre_probability DESC, s.skill) AS INTEGER) AS rn
  FROM groups g JOIN stats3 s ON g.duty = s.duty AND g.category = s.category JOIN ranked r ON s.duty = r.duty AND s.category = r.category AND r.rank <= {limit}
    AND (list_contains(string_split(s.skill, ', '), r.skill){ends})
  WHERE s.probability >= 0.03 AND len([x FOR x IN string_split(s.skill, ', ') IF NOT list_contains(g.owned, x)]) > 0),
alls AS (SELECT profile_id, duty, category, array_to_string(list_sort(list(DISTINCT rskill)), ', ') AS whole FROM open GROUP BY ALL),
numbered AS (SELECT o.*, row_number() OVER (PARTITION BY profile_id, duty, category, rrank ORDER BY rn) AS nth FROM open o JOIN alls USING (profile_id, duty, category) WHERE skill <> whole),
cut AS (SELECT * FROM numbered WHERE rrank <> 1 OR nth <= 2),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, duty, category, skill ORDER BY rrank, rn) AS a FROM cut) WHERE a = 1),
suggested AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, duty, category, rrank ORDER BY rn) AS b FROM once) WHERE b <= {per_rank})"""


def suggest_sql(*options) -> str:
    return with_ctes(V2_STATS_SQL, V2_SETS_SQL, V7_SQL, suggest_ctes(*options), body="")


SUGGEST_SQL = suggest_ctes()
SUGGEST = suggest_sql()
SUGGESTED = """SELECT profile_id, duty, category, skill, round(probability, 2) AS probability, rskill,
  round(rprobability, 2) AS rprobability, rrank, rn FROM suggested"""


def suggestions(spark, folder, **options):
    return S.suggest_skill_sets(profile_groups(v7(spark, folder)), both_units(spark, folder), probability=SET_SHARE, **options)


@query("c03_suggest_skill_sets", SUGGEST + SUGGESTED)
def _(spark, folder):
    return suggestions(spark, folder)


@query("c03_three_ranks", suggest_sql(3) + SUGGESTED)
def _(spark, folder):
    return suggestions(spark, folder, limit=3)


@query("c03_five_per_rank", suggest_sql(2, 5) + SUGGESTED)
def _(spark, folder):
    return suggestions(spark, folder, per_rank=5)


@query("c03_strict_like", suggest_sql(2, 2, True) + SUGGESTED)
def _(spark, folder):
    return suggestions(spark, folder, strict_like=True)


@query("w06_first_n_per_group", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT duty, category, skill FROM (SELECT *, row_number() OVER (PARTITION BY duty, category ORDER BY probability DESC, pre_probability DESC, skill) AS n FROM stats3) WHERE n <= 2"""))
def _(spark, folder):
    return first_per_key(stats3(spark, folder), ["duty", "category"], S.skill_order(), 2).select("duty", "category", "skill")


@query("w07_keep_first_by_key", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT skill, duty, category FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY probability DESC, pre_probability DESC, duty) AS n FROM stats3) WHERE n = 1"""))
def _(spark, folder):
    order = [F.desc("probability"), F.desc("pre_probability"), F.asc("duty")]
    return first_per_key(stats3(spark, folder), ["skill"], order).select("skill", "duty", "category")


@query("c08_set_groups_report", SUGGEST + """SELECT profile_id, duty, category, rskill, skill,
  CAST(row_number() OVER (PARTITION BY profile_id, duty, category, rskill ORDER BY rrank, rn) - 1 AS INTEGER) AS place FROM suggested""")
def _(spark, folder):
    return S.set_groups_report(suggestions(spark, folder)).select("profile_id", "duty", "category", "rskill", "skill", "place")
