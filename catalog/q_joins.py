"""N, and the filters that are joins."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    V2_SETS_SQL, V2_SQL, V2_STATS_SQL, V3_SQL, V7_SQL, WEIGHTS, table, v2_baskets, v2_totals, v3, v7, with_ctes,
)
from postlens.operators import distribution as A, joins as J, skills as S
from postlens.plans.profiles import profile_groups
from postlens.sources.dictionaries import duty_weights


def stats1(spark, folder):
    return S.skill_support(v2_baskets(spark, folder), v2_totals(spark, folder))


def stats3(spark, folder, min_support=0.0):
    return S.skill_set_support(v2_baskets(spark, folder), v2_totals(spark, folder), min_support)


WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', '{c}', {w}::DOUBLE)" for d, ws in WEIGHTS.items() for c, w in zip(S.K.CATEGORIES, ws)
) + ") w(duty, category, weight))"


@query("n01_inner_join_by_id", """
SELECT o_orderpriority, count(*) AS lines, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    return J.inner_join_by_id(orders, lines, "id").groupBy("o_orderpriority").agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("n02_join_group_totals", with_ctes(V3_SQL, body="""
SELECT c.category, career, count, total_jobs FROM (SELECT category, career, count(*) AS count FROM v3d GROUP BY ALL) c
JOIN (SELECT category, count(*) AS total_jobs FROM v3d GROUP BY ALL) t ON c.category = t.category"""))
def _(spark, folder):
    rows = v3(spark, folder)
    return J.join_group_totals(A.career_counts(rows), A.category_totals(rows), "category")


@query("n03_contains_element_join", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT s.duty, s.category, s.skill, r.skill AS rskill FROM stats3 s JOIN ranked r ON s.duty = r.duty AND s.category = r.category AND r.rank <= 2
  AND list_contains(string_split(s.skill, ', '), r.skill)"""))
def _(spark, folder):
    ranked = S.top_skills(stats1(spark, folder)).select("duty", "category", F.col("skill").alias("rskill"))
    return J.contains_element_join(stats3(spark, folder).select("duty", "category", "skill"), ranked, ["duty", "category"])


@query("n03_contains_element_join_strict", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
, r AS (SELECT duty, category, upper(skill) AS skill FROM ranked WHERE rank <= 2 UNION ALL SELECT duty, category, replace(skill, 'brand ', '') FROM ranked)
SELECT s.duty, s.category, s.skill, r.skill AS rskill FROM stats3 s JOIN r ON s.duty = r.duty AND s.category = r.category
  AND (s.skill ILIKE r.skill || ',%' OR s.skill ILIKE '% ' || r.skill OR s.skill ILIKE '% ' || r.skill || ',%')""").replace("\n\n, r AS", ",\nr AS"))
def _(spark, folder):
    ranked = S.rank_skills(stats1(spark, folder))
    names = ranked.filter("rank <= 2").select("duty", "category", F.upper("skill").alias("rskill")).unionByName(
        ranked.select("duty", "category", F.replace("skill", F.lit("brand "), F.lit("")).alias("rskill")))
    return J.contains_element_join(stats3(spark, folder).select("duty", "category", "skill"), names, ["duty", "category"], strict_like=True)


@query("n04_lookup_with_default", """
SELECT p_partkey, coalesce('B-' || n_regionkey, 'O') AS label FROM part LEFT JOIN nation n ON lower(p_brand) = 'brand#' || (n_nationkey + 5)""")
def _(spark, folder):
    names = table(spark, folder, "nation").select(
        F.concat(F.lit("brand#"), (F.col("n_nationkey") + 5).cast("string")).alias("key"), F.concat(F.lit("B-"), F.col("n_regionkey").cast("string")).alias("value"))
    return J.lookup_with_default(table(spark, folder, "part").select("p_partkey", "p_brand"), names, F.lower("p_brand"), "O", "label").drop("p_brand")


@query("n05_new_names_semi_join", """
SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size > 45 AND trim(lower(b.p_name)) = trim(lower(p.p_name)))""")
def _(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("p_name"), "p_size")
    base = part.filter("p_size > 45").select(F.trim(F.lower("p_name")).alias("p_name"))
    return J.new_names(part, base, "p_name").select("p_partkey", F.trim(F.lower("p_name")).alias("p_name"))


@query("n06_align_counts_outer_join", """
SELECT coalesce(a.year, b.year) AS year, coalesce(a.c, 0) AS original_count, coalesce(b.c, 0) AS new_count, coalesce(b.c, 0) - coalesce(a.c, 0) AS difference
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS c FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01' GROUP BY 1) a
FULL JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' GROUP BY 1) b ON a.year = b.year""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_orderdate") < "1997-07-01").alias("early"))
    count = lambda early: orders.filter(F.col("early") == early).groupBy("year").count()
    return J.align_counts(count(True), count(False), "year")


@query("n07_weights_join", with_ctes(V2_STATS_SQL, WEIGHTS_SQL, body="""
SELECT s.duty, s.category, s.skill, w.weight FROM stats1 s LEFT JOIN weights w ON s.duty = w.duty AND s.category = w.category"""))
def _(spark, folder):
    return J.attach_weights(stats1(spark, folder), duty_weights(spark, WEIGHTS)).select("duty", "category", "skill", "weight")


@query("n08_scalar_subquery_share", """
SELECT l_returnflag, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS percentage FROM lineitem GROUP BY l_returnflag""")
def _(spark, folder):
    return J.share_of_table(table(spark, folder, "lineitem"), "l_returnflag")


@query("n09_relabel_from_lookup", """
SELECT p_partkey, CASE WHEN p_size > 20 THEN 'B-' || p_type ELSE coalesce('N-' || n_regionkey, 'O') END AS label
FROM part LEFT JOIN nation ON p_brand = 'Brand#' || n_nationkey""")
def _(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("tag"), F.when(F.col("p_size") > 20, F.concat(F.lit("B-"), "p_type")).otherwise("O").alias("label"))
    labels = table(spark, folder, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("tag"), F.concat(F.lit("N-"), F.col("n_regionkey").cast("string")).alias("new_label"))
    return J.relabel_from_lookup(part, labels, "tag", "label").drop("tag")


@query("p18_exclude_user_combinations", with_ctes(V2_STATS_SQL, V2_SETS_SQL, V7_SQL, body="""
SELECT g.profile_id, s.category, count(*) AS sets FROM stats3 s JOIN groups g ON s.duty = g.duty AND s.category = g.category
WHERE len([x FOR x IN string_split(s.skill, ', ') IF NOT list_contains(g.owned || ['brand 5', 'brand 9', 'brand 13'], x)]) > 0 GROUP BY ALL"""))
def _(spark, folder):
    more = F.array(*[F.lit(f"brand {n}") for n in (5, 9, 13)])
    groups = profile_groups(v7(spark, folder)).withColumn("owned_skills", F.concat("owned_skills", more))
    rows = S.open_sets(groups, stats3(spark, folder)).groupBy("profile_id", "category").agg(F.sum(F.size("open")).alias("sets"))
    return rows.filter("sets > 0")


@query("p18_on_joined_sets", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT duty, category, skill FROM stats3 WHERE len([x FOR x IN string_split(skill, ', ') IF NOT list_contains(['brand 1', 'brand 5', 'brand 9', 'brand 13'], x)]) > 0"""))
def _(spark, folder):
    own = F.array(*[F.lit(f"brand {n}") for n in (1, 5, 9, 13)])
    return S.exclude_user_combinations(stats3(spark, folder).withColumn("owned_skills", own)).select("duty", "category", "skill")


@query("p25_match_set_to_text", with_ctes(V2_STATS_SQL, V2_SETS_SQL, body="""
SELECT s.duty, s.category, s.skill, coalesce(min_by(t.text, t.ord), '') AS text FROM stats3 s
LEFT JOIN (SELECT duty, category, rank AS ord, skill || CASE WHEN rank = 1 THEN ', and 1' ELSE '' END AS key, 'text ' || skill AS text FROM ranked WHERE rank <= 3) t
  ON s.duty = t.duty AND s.category = t.category AND list_aggregate([contains(s.skill, k) FOR k IN string_split(t.key, ', ')], 'bool_and')
GROUP BY ALL"""))
def _(spark, folder):
    texts = S.top_skills(stats1(spark, folder), 3).select(
        "duty", "category", F.col("rank").alias("ord"), F.concat("skill", F.when(F.col("rank") == 1, ", and 1").otherwise("")).alias("key"),
        F.concat(F.lit("text "), "skill").alias("text"))
    sets = stats3(spark, folder).select("duty", "category", "skill")
    return J.match_set_to_text(sets, texts, ["duty", "category"])
