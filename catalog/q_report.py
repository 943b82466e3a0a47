"""C7, C9, C10 and the whole jobs."""

from pyspark.sql import functions as F

from catalog.q_distribution import DEGREE, LANGUAGE, RATIO
from catalog.q_joins import WEIGHTS_SQL
from catalog.q_recommend import TFIDF_SQL
from catalog.q_skills import NEAR_SQL, SCORES_SQL, SET_SHARE, SUGGEST_SQL, both_units
from catalog.q_sources import RAW_A_SQL, raw_a, raw_b
from catalog.registry import query
from catalog.views import (
    CATEGORY_OF, DUTY_NAMES, V2_LISTS_SQL, V2_SETS_SQL, V2_STATS_SQL, V3_SQL, V7_SQL, WEIGHTS, pick, table, v2_skill_lists, v3, v7, with_ctes,
)
from postlens.operators.distribution import explode_duties
from postlens.plans import etl, report
from postlens.plans.summary import duty_analysis
from postlens.session import saved_copy
from postlens.plans.profiles import profile_keys
from postlens.sources.dictionaries import duty_weights


def report_cache(spark, folder):
    """Stored reports of the profiles of three regions."""
    region = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("profile_id"), "n_regionkey")
    keys = profile_keys(v7(spark, folder)).join(region, "profile_id").filter("n_regionkey < 3")
    return keys.select(
        (F.col("profile_id") + 100).alias("seq"), *report.CACHE_KEY, F.lit("stored").alias("improvement"),
        F.lit("stored").alias("conclusion"), F.lit("2025-01-01").alias("an_dt"),
    )


CACHE_SQL = "cache AS (SELECT v7.profile_id + 100 AS seq, k.duty, it_language, framework, library, tool FROM pkeys k JOIN v7 ON k.profile_id = v7.profile_id WHERE n_regionkey < 3)"


@query("c07_cached_report_lookup", with_ctes(V7_SQL, CACHE_SQL, body="""
SELECT k.*, min(c.seq) AS seq FROM pkeys k LEFT JOIN cache c ON k.duty = c.duty AND k.it_language = c.it_language AND k.framework = c.framework
  AND k.library = c.library AND k.tool = c.tool GROUP BY ALL"""))
def _(spark, folder):
    return report.cached_reports(v7(spark, folder), report_cache(spark, folder))


@query("c07_cached_report_lookup_wildcard", with_ctes(V7_SQL, CACHE_SQL, body="""
SELECT k.*, min(c.seq) AS seq FROM pkeys k LEFT JOIN cache c ON k.duty = c.duty AND c.it_language = coalesce(nullif(k.it_language, ''), c.it_language)
  AND c.framework = coalesce(nullif(k.framework, ''), c.framework) AND c.library = coalesce(nullif(k.library, ''), c.library)
  AND c.tool = coalesce(nullif(k.tool, ''), c.tool) GROUP BY ALL"""))
def _(spark, folder):
    return report.cached_reports(v7(spark, folder), report_cache(spark, folder), wildcard=True)


@query("c07_store_missing_reports", with_ctes(V7_SQL, CACHE_SQL, body="""
SELECT seq, duty, it_language, framework, library, tool, 'stored' AS improvement FROM cache UNION ALL
SELECT (SELECT max(seq) FROM cache) + row_number() OVER (ORDER BY duty, it_language, framework, library, tool), duty, it_language, framework, library, tool, 'new' || min(profile_id)
FROM pkeys k WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE k.duty = c.duty AND k.it_language = c.it_language AND k.framework = c.framework AND k.library = c.library AND k.tool = c.tool)
GROUP BY duty, it_language, framework, library, tool"""))
def _(spark, folder):
    profiles = v7(spark, folder)
    computed = profiles.select("profile_id", F.concat(F.lit("new"), F.col("profile_id").cast("string")).alias("improvement"), F.lit("new").alias("conclusion"))
    return report.store_missing_reports(profiles, report_cache(spark, folder), computed, "2025-01-02").drop("conclusion", "an_dt")


def summaries(spark, folder):
    """Summary cells per duty, with the number of orders of each state in their text."""
    def n(state):
        return F.count_if(F.col("o_orderstatus") == state).cast("string").alias("n_" + state)

    rows = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("duty")).agg(n("F"), n("O"))
    f, o, lit = F.col("n_F"), F.col("n_O"), F.lit
    return rows.select(
        "duty",
        F.concat(lit("['img/"), "duty", lit(".png', '1. F "), f, lit("/n\\n\\n2. O "), o, lit(". x']")).alias("career"),
        F.concat(lit("['img\\"), "duty", lit(".png', '- F "), f, lit(". - O "), o, lit(". End.  3.5 x']")).alias("degree"),
        F.when(F.col("duty") != "5-LOW", F.concat(lit("['img', '1. F "), f, lit(" 2. O "), o, lit("']"))).otherwise(lit("['img only']")).alias("language"),
    )


SUMMARY_SQL = """cells AS (SELECT o_orderpriority AS duty, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1),
lines AS (SELECT duty, 'career' AS part, 'img/' || duty || '.png' AS path, unnest(['F ' || f, 'O ' || o || '. x']) AS line, unnest([0, 1]) AS line_no FROM cells
UNION ALL SELECT duty, 'degree', 'img/' || duty || '.png', unnest(['F ' || f || '.', 'O ' || o || '. End', '3.5 x']), unnest([0, 1, 2]) FROM cells
UNION ALL SELECT duty, 'language', 'img', unnest(['F ' || f, 'O ' || o]), unnest([0, 1]) FROM cells WHERE duty <> '5-LOW')"""


@query("c09_duty_summary_rows", with_ctes(V7_SQL, SUMMARY_SQL, body="SELECT profile_id, l.* FROM v7 JOIN lines l ON v7.duty = l.duty"))
def _(spark, folder):
    return report.duty_summary_rows(v7(spark, folder), summaries(spark, folder))


def report_rows(parts):
    """Every row of every part as text, so that contents are compared."""
    cells = {
        "ranks": ["duty", "category", "skill", "rank", "owned", "gap_before"], "sets": ["category", "rskill", "skill", "place"],
        "duties": ["place", "duty"], "postings": ["place", "id"], "summaries": ["duty", "part", "path", "line_no", "line"],
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), "profile_id", F.concat_ws("|", *[F.col(c).cast("string") for c in cells[name]]).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("c10_profile_report", with_ctes(V2_STATS_SQL, V2_LISTS_SQL, V2_SETS_SQL, V7_SQL, WEIGHTS_SQL, NEAR_SQL, SUGGEST_SQL, SCORES_SQL, SUMMARY_SQL, TFIDF_SQL, body="""
SELECT 'ranks' AS part, profile_id, concat_ws('|', duty, category, skill, rank, owned, coalesce(rank > lag(rank) OVER (PARTITION BY profile_id, duty, category ORDER BY rank) + 1, false)) AS content FROM marked
UNION ALL SELECT 'sets', profile_id, concat_ws('|', category, rskill, skill, row_number() OVER (PARTITION BY profile_id, duty, category, rskill ORDER BY rrank, rn) - 1) FROM suggested WHERE category <> 'tool'
UNION ALL SELECT 'duties', profile_id, concat_ws('|', place, duty) FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, duty) AS place FROM (
  SELECT o.profile_id, s.duty, CASE WHEN count(w.weight) = count(*) THEN round(sum(100 * (pow(10, p / 100) - 1) / ((pow(10, p / 100) - 1) + (pow(10, (100 - p) / 100) - 1)) * w.weight), 2) END AS score
  FROM (SELECT DISTINCT profile_id FROM own) o JOIN (SELECT o.profile_id, s.duty, s.category, sum(s.probability) AS p FROM own o JOIN stats1 s ON o.skill = s.skill WHERE s.probability <> 0 GROUP BY ALL) s USING (profile_id)
  LEFT JOIN weights w ON s.duty = w.duty AND s.category = w.category GROUP BY ALL)) WHERE place <= 3
UNION ALL SELECT 'postings', profile_id, concat_ws('|', place, id) FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) AS place FROM every) WHERE place <= 10
UNION ALL SELECT 'summaries', profile_id, concat_ws('|', l.duty, part, path, line_no, line) FROM v7 JOIN lines l ON v7.duty = l.duty"""))
def _(spark, folder):
    postings = saved_copy(v2_skill_lists(spark, folder).select("id", F.array_join("skills", " ").alias("skills")), "postings")
    parts = report.profile_report(
        v7(spark, folder), both_units(spark, folder), duty_weights(spark, WEIGHTS), postings, summaries(spark, folder), SET_SHARE)
    return report_rows(parts)


@query("e03_duty_analysis", with_ctes(V3_SQL, body=f"""
, old AS (SELECT DISTINCT category AS duty FROM v3d WHERE category <> 'LOW' UNION ALL SELECT 'no postings'),
lang AS (SELECT category, string_agg('- ' || language_required || ': ' || percentage || '%', chr(10) ORDER BY percentage DESC, language_required) AS t
  FROM (SELECT category, {LANGUAGE} AS language_required, {RATIO} AS percentage FROM v3d GROUP BY category, language_required) GROUP BY category),
car AS (SELECT category, string_agg('- ' || CASE WHEN career = 0 THEN '신입사원' ELSE career || '년차' END || ': ' || ratio || '%', chr(10) ORDER BY career) AS t
  FROM (SELECT category, career, {RATIO} AS ratio FROM v3d GROUP BY category, career) GROUP BY category),
deg AS (SELECT category, string_agg('- ' || degree_required || ': ' || percentage || '%', chr(10) ORDER BY percentage DESC, degree_required) AS t
  FROM (SELECT category, {DEGREE} AS degree_required, {RATIO} AS percentage FROM v3d GROUP BY category, degree_required) GROUP BY category)
SELECT coalesce(old.duty, lang.category) AS duty, concat_ws('|', old.duty || '.png', lang.t) AS language, concat_ws('|', old.duty || '.png', car.t) AS career, concat_ws('|', old.duty || '.png', deg.t) AS degree
FROM old FULL JOIN lang ON duty = lang.category LEFT JOIN car ON car.category = lang.category LEFT JOIN deg ON deg.category = lang.category""").replace("\n\n, old", ",\nold"))
def _(spark, folder):
    """New texts for every duty; one duty is new to the table and one has no postings."""
    postings = v3(spark, folder)
    names = explode_duties(postings.select("duty"), known=DUTY_NAMES).select("category").distinct().filter("category <> 'LOW'")
    names = names.unionByName(spark.createDataFrame([("no postings",)], "category string"))
    cell = F.array(F.concat("category", F.lit(".png")))
    old = names.select(F.col("category").alias("duty"), *[cell.alias(c) for c in ("language", "career", "degree")])
    out = duty_analysis(postings, old, known=DUTY_NAMES)
    return out.select("duty", *[F.array_join(c, "|").alias(c) for c in ("language", "career", "degree")])


DUTY_ELEMENTS = [("백엔드", "서버/백엔드"), ("백엔드, 프론트 엔드", "웹 풀스택"), ("데이터 분석", "데이터 분석"),
                 ("프론트 엔드", "프론트엔드"), ("PM", "seg"), ("삭제", "F")]


@query("e02_categorised_postings", with_ctes(RAW_A_SQL, body=f"""
, s AS (SELECT id, {', '.join(f"coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (category = '{c}'), '') AS {c}" for c in CATEGORY_OF)}
  FROM (SELECT DISTINCT id, category, skill FROM v2) GROUP BY id)
SELECT s.*, 'https://career.programmers.co.kr' || CASE WHEN o_orderstatus <> 'P' THEN '/job/' || id ELSE '' END AS url,
  CASE WHEN o_custkey % 13 = 0 THEN '프론트 엔드' WHEN o_orderpriority = '1-URGENT' THEN '백엔드, 프론트 엔드' ELSE '데이터 분석' END AS duty
FROM s JOIN a ON s.id = o_orderkey WHERE NOT broken AND NOT rootless
UNION ALL SELECT s.*, 'https://www.wanted.co.kr/wd/' || id, CASE WHEN o_orderstatus <> 'P' THEN 'PM' END FROM s JOIN orders ON id = o_orderkey
""").replace("\n\n, s AS", ",\ns AS"))
def _(spark, folder):
    """Both raw feeds to the categorised table: decode, clean, tokenise, classify."""
    duties = spark.createDataFrame(DUTY_ELEMENTS, "name string, synonym string")
    brand = F.substring("p_brand", 7, 10).cast("int")
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    elements = table(spark, folder, "part").select(
        brand.alias("seq"), F.when(brand % 4 == 0, "language").otherwise(pick(brand % 4, CATEGORY_OF)).alias("category"),
        name.alias("name"), F.concat(F.replace(name, F.lit(" "), F.lit("")), F.lit(","), name).alias("synonym")).distinct()
    postings = etl.postings_from_feeds(raw_a(spark, folder).select("text"), raw_b(spark, folder), duties, "2025-01-24-12")
    terms = spark.createDataFrame([("spring boot",)], "term string")
    out = etl.categorise_postings(postings, elements, terms)
    return out.select("id", "url", "duty", *CATEGORY_OF)
