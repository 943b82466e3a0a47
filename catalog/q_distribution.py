"""A, U2, O4: per-duty distributions."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import DUTY_NAMES, V3_SQL, table, v3, with_ctes
from postlens.functions.text import percent_text
from postlens.operators import distribution as A, joins as J, sets as U
from postlens.streaming.interest import keyword_counts

RATIO = "round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 2)"
LANGUAGE = "CASE language WHEN 1 THEN '영어' WHEN 2 THEN '일본어' WHEN 3 THEN '중국어' ELSE '무관' END"
DEGREE = "CASE degree WHEN 0 THEN '무관/없음' WHEN 1 THEN '학사' WHEN 2 THEN '석사&박사' END"


@query("u02_union_per_category", with_ctes(V3_SQL, body=" UNION ALL ".join(
    f"SELECT '{n}' AS category, id, career FROM v3 WHERE duty ILIKE '%{n}%'" for n in DUTY_NAMES)))
def _(spark, folder):
    return A.explode_duties(v3(spark, folder), known=DUTY_NAMES).select("category", "id", "career")


@query("a01_category_totals", with_ctes(V3_SQL, body="SELECT category, count(*) AS total_jobs FROM v3d GROUP BY category"))
def _(spark, folder):
    return A.category_totals(v3(spark, folder), known=DUTY_NAMES)


@query("a02_language_distribution", with_ctes(V3_SQL, body=f"""
SELECT category, {LANGUAGE} AS language_required, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT) AS total_jobs, {RATIO} AS percentage
FROM v3d GROUP BY category, language_required"""))
def _(spark, folder):
    return A.language_distribution(v3(spark, folder), known=DUTY_NAMES)


@query("a03_degree_distribution", with_ctes(V3_SQL, body=f"""
SELECT category, {DEGREE} AS degree_required, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT) AS total_jobs, {RATIO} AS percentage
FROM v3d GROUP BY category, degree_required"""))
def _(spark, folder):
    return A.degree_distribution(v3(spark, folder), known=DUTY_NAMES)


@query("a04_overall_degree_share", with_ctes(V3_SQL, body=f"""
SELECT {DEGREE} AS degree_required, round(count(*) * 100.0 / (SELECT count(*) FROM v3), 2) AS percentage FROM v3 GROUP BY degree"""))
def _(spark, folder):
    return A.overall_share(v3(spark, folder), "degree", A.code_to_label("degree", A.K.DEGREE_LABELS), "degree_required")


@query("a05_career_counts", with_ctes(V3_SQL, body="SELECT category, career, count(*) AS count FROM v3d GROUP BY category, career"))
def _(spark, folder):
    return A.career_counts(v3(spark, folder))


@query("a06_career_ratio", with_ctes(V3_SQL, body=f"SELECT category, career, count(*) AS count, {RATIO} AS ratio FROM v3d GROUP BY category, career"))
def _(spark, folder):
    return A.career_ratio(v3(spark, folder)).orderBy("category", "career")


@query("a07_raw_duty_career_counts", with_ctes(V3_SQL, body="SELECT duty, career, count(*) AS count FROM v3 GROUP BY duty, career"))
def _(spark, folder):
    return A.raw_duty_career_counts(v3(spark, folder))


@query("a08_career_summary", with_ctes(V3_SQL, body="""
SELECT category, max(CASE WHEN rn = 1 THEN career END) AS first_career, max(CASE WHEN rn = 1 THEN c END) AS first_count,
  max(CASE WHEN rn = 2 THEN career END) AS second_career, max(CASE WHEN rn = 2 THEN c END) AS second_count, min(career) AS min_career
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY c DESC, career) AS rn FROM (SELECT category, career, count(*) AS c FROM v3d GROUP BY ALL)) GROUP BY category"""))
def _(spark, folder):
    return A.career_summary(A.career_counts(v3(spark, folder)))


@query("a09_label_term_counts", """
SELECT p_type AS ner_label, CAST(sum(1 + CASE WHEN p_size % 3 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) END) AS BIGINT) AS total_count FROM part GROUP BY p_type""")
def _(spark, folder):
    synonym = F.when(F.col("p_size") % 6 == 0, None).when(F.col("p_size") % 3 == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit(",")))
    return A.label_term_counts(table(spark, folder, "part").select(F.col("p_type").alias("ner_label"), synonym.alias("synonym")))


@query("a10_value_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand")
def _(spark, folder):
    return A.value_counts(table(spark, folder, "part"), "p_brand")


@query("a11_collect_group_rows", with_ctes(V3_SQL, body=f"""
SELECT category, string_agg(career || '=' || ratio, ';' ORDER BY career) AS rows FROM (SELECT category, career, {RATIO} AS ratio FROM v3d GROUP BY category, career) GROUP BY category"""))
def _(spark, folder):
    rows = A.collect_group_rows(A.career_ratio(v3(spark, folder)), "category", ["career", "ratio"])
    text = F.transform("rows", lambda r: F.concat(r["career"].cast("string"), F.lit("="), r["ratio"].cast("string")))
    return rows.select("category", F.array_join(text, ";").alias("rows"))


@query("a12_group_to_text_lines", with_ctes(V3_SQL, body=f"""
SELECT category, string_agg('- ' || CASE WHEN career = 0 THEN '신입사원' ELSE career || '년차' END || ': ' || ratio || '%', chr(10) ORDER BY career) AS lines
FROM (SELECT category, career, {RATIO} AS ratio FROM v3d GROUP BY category, career) GROUP BY category"""))
def _(spark, folder):
    return A.group_to_text_lines(A.career_ratio(v3(spark, folder)))


@query("a12_count_lines", with_ctes(V3_SQL, body="""
SELECT category, string_agg('- ' || career || '년차: ' || c || '건', chr(10) ORDER BY career) AS lines
FROM (SELECT category, career, count(*) AS c FROM v3d GROUP BY category, career) GROUP BY category"""))
def _(spark, folder):
    return A.count_lines(A.career_counts(v3(spark, folder)))


@query("a15_trend_extent", """
WITH w AS (SELECT time_bucket(INTERVAL 7 DAYS, ts) AS bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1)
SELECT max(greatest(click, view)) AS max_value, CAST(list(bucket ORDER BY bucket)[CAST(count(*) // 2 AS INTEGER) + 1] AS DATE)::VARCHAR AS middle_date FROM w""")
def _(spark, folder):
    counts = keyword_counts(table(spark, folder, "events"), "ts", "event_type")
    series = counts.groupBy("bucket").pivot("keyword", ["click", "view"]).agg(F.sum("mentions"))
    out = A.trend_extent(series, "bucket", ["click", "view"])
    return out.select("max_value", F.date_format("middle_date", "yyyy-MM-dd").alias("middle_date"))


@query("a16_distinct_labels_missing", "SELECT p_type FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 25 AND p_type <> 'PROMO'")
def _(spark, folder):
    part = table(spark, folder, "part")
    return U.labels_missing(part, part.filter("p_size > 25 AND p_type <> 'PROMO'"), "p_type")


@query("o02_sort_multi_key", with_ctes(V3_SQL, body=f"""
SELECT category, {DEGREE} AS degree_required, {RATIO} AS percentage FROM v3d GROUP BY category, degree_required"""))
def _(spark, folder):
    rows = A.degree_distribution(v3(spark, folder)).orderBy("category", F.desc("percentage"), "degree_required")
    return rows.select("category", "degree_required", "percentage")


@query("o04_sort_percent_as_text", with_ctes(V3_SQL, body=f"""
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY pct DESC, career) AS INTEGER) AS place FROM
(SELECT category, career, {RATIO} || '%' AS pct FROM v3d GROUP BY category, career)"""))
def _(spark, folder):
    from pyspark.sql import Window

    rows = A.career_ratio(v3(spark, folder)).select("category", "career", percent_text("ratio").alias("pct"))
    order = Window.partitionBy("category").orderBy(F.desc("pct"), "career")
    return rows.withColumn("place", F.row_number().over(order)).orderBy("category", F.desc("pct"), "career")
