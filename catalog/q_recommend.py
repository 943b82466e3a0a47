"""Recommendations."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import V2_LISTS_SQL, V2_SQL, V6_SQL, V7_SQL, pick, table, v2_rows, v2_skill_lists, v6_items, v6_queries, v7, with_ctes
from postlens.operators import cells as C, recommend as R
from postlens.plans.profiles import profile_texts
from postlens.session import saved_copy

TFIDF_SQL = """pt AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(array_to_string(skills, ' ')), '\\b\\w\\w+\\b')) AS term FROM lists) GROUP BY id, term),
n AS (SELECT count(*) + 2.0::DOUBLE AS n FROM lists),
idf AS (SELECT term, ln(any_value(n.n) / (count(*) + 1)) + 1 AS idf, ln(any_value(n.n) / (count(*) + 2)) + 1 AS own FROM pt, n GROUP BY term),
ot AS (SELECT profile_id, term, count(*) AS ptf FROM (SELECT profile_id, unnest(regexp_extract_all(lower(string_agg(skill, ' ')), '\\b\\w\\w+\\b')) AS term FROM own GROUP BY profile_id) GROUP BY profile_id, term),
ow AS (SELECT profile_id, ot.term, ptf, coalesce(own, ln(n.n / 2) + 1) AS own FROM ot LEFT JOIN idf ON ot.term = idf.term, n),
pn AS (SELECT profile_id, sum((ptf * own) ** 2) AS pnorm FROM ow GROUP BY profile_id),
base AS (SELECT id, sum((tf * idf) ** 2) AS norm FROM pt JOIN idf USING (term) GROUP BY id),
raw AS (SELECT ow.profile_id, pt.id, sum(ptf * ow.own * tf * ow.own) AS dot, sum((tf * ow.own) ** 2 - (tf * idf.idf) ** 2) AS shift
  FROM pt JOIN ow ON pt.term = ow.term JOIN idf ON pt.term = idf.term GROUP BY ow.profile_id, pt.id),
best AS (SELECT raw.profile_id, raw.id, round(dot / sqrt((norm + shift) * pnorm), 9) AS score FROM raw JOIN base ON raw.id = base.id JOIN pn ON raw.profile_id = pn.profile_id),
every AS (SELECT profile_id, id, score FROM best UNION ALL SELECT v.profile_id, l.id, 0.0 FROM v7 v, lists l
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.profile_id = v.profile_id AND b.id = l.id))"""


@query("c01_recommend_postings_tfidf", with_ctes(V2_SQL, V2_LISTS_SQL, V7_SQL, TFIDF_SQL, body="""
SELECT profile_id, id, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) AS INTEGER) AS place FROM every) WHERE place <= 10"""))
def _(spark, folder):
    postings = saved_copy(v2_skill_lists(spark, folder).select("id", F.array_join("skills", " ").alias("skills")), "postings")
    best = R.recommend_postings_tfidf(postings, profile_texts(v7(spark, folder)))
    return best.withColumn("score", F.round("score", 6))


@query("c01_recommend_to_customers", with_ctes(V2_SQL, V2_LISTS_SQL, """own AS (SELECT DISTINCT o_custkey AS profile_id, skill FROM v2 JOIN orders ON o_orderkey = id)""",
    TFIDF_SQL[:TFIDF_SQL.index(",\nevery AS")], body="""
SELECT profile_id, id, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) AS INTEGER) AS place FROM best) WHERE place <= 10"""))
def _(spark, folder):
    """Every customer with orders is a profile, of the skills in its orders; each posting shares a term with each."""
    rows = saved_copy(v2_rows(spark, folder).select("id", "skill"), "skill-rows")
    postings = saved_copy(rows.groupBy("id").agg(F.array_join(F.collect_set("skill"), " ").alias("skills")), "postings")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile_id"))
    own = rows.join(orders, "id").groupBy("profile_id").agg(F.array_join(F.collect_set("skill"), " ").alias("skills"))
    return R.recommend_postings_tfidf(postings, own).withColumn("score", F.round("score", 6))


@query("c05_filtered_vector_search", with_ctes(V6_SQL, body="SELECT query_id, id, round(score, 6) AS score, place FROM hits"))
def _(spark, folder):
    hits = R.filtered_vector_search(v6_items(spark, folder), v6_queries(spark, folder), R.matches_filters(equal=["label"]))
    return hits.withColumn("score", F.round("score", 6))


MIXED_SQL = """
WITH items AS (SELECT vec_id AS id, embedding, ['Data AI', 'Backend', 'Data Ops'][label % 3 + 1] AS duty, vec_id % 4 AS career, label % 3 AS degree,
  ['c, java', 'go', 'Python , c', 'rust'][vec_id % 4 + 1] AS it_language FROM embeddings),
requests AS (SELECT vec_id AS query_id, embedding AS vector, ['data', '', 'BACK', NULL][vec_id % 4 + 1] AS duty, vec_id % 4 AS career, CAST(vec_id % 2 AS INTEGER) AS degree,
  [['java', 'go'], [], ['python']][vec_id % 3 + 1] AS it_language FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, id, round(list_cosine_similarity(i.embedding::DOUBLE[], r.vector::DOUBLE[]), 9) AS score FROM items i, requests r
  WHERE (coalesce(r.duty, '') = '' OR contains(lower(i.duty), lower(r.duty))) AND i.career = r.career AND (r.degree = 0 OR i.degree = r.degree)
    AND (len(r.it_language) = 0 OR list_has_any(regexp_split_to_array(lower(i.it_language), '\\s*,\\s*'), r.it_language)))
SELECT query_id, id, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM scored) WHERE place <= 5"""


def mixed_requests(spark, folder):
    """Items and requests with metadata for every kind of filter, and the condition."""
    vectors = table(spark, folder, "embeddings")
    number, label = F.col("vec_id"), F.col("label")
    items = vectors.select(
        number.alias("id"), "embedding", pick(label % 3, ("Data AI", "Backend", "Data Ops")).alias("duty"), (number % 4).alias("career"),
        (label % 3).alias("degree"), pick(number % 4, ("c, java", "go", "Python , c", "rust")).alias("it_language"))
    wanted = F.array(F.array(F.lit("java"), F.lit("go")), F.array().cast("array<string>"), F.array(F.lit("python")))
    requests = vectors.filter(number % 100 == 0).select(
        number.alias("query_id"), F.col("embedding").alias("vector"), pick(number % 4, ("data", "", "BACK", None)).alias("duty"),
        (number % 4).alias("career"), (number % 2).cast("int").alias("degree"), F.get(wanted, (number % 3).cast("int")).alias("it_language"))
    match = R.matches_filters(equal=["career"], contains=["duty"], optional=["degree"], overlap=["it_language"])
    return items, requests, match


@query("c05_mixed_filters", MIXED_SQL)
def _(spark, folder):
    return R.filtered_vector_search(*mixed_requests(spark, folder), block=7).withColumn("score", F.round("score", 6))


@query("c05_cell_search_exact", MIXED_SQL)
def _(spark, folder):
    items, requests, match = mixed_requests(spark, folder)
    return C.cell_search(C.build_cells(items), requests, match, exact=True).withColumn("score", F.round("score", 6))


@query("c05_cell_search_recall", """
SELECT count(*) AS requests, least(count(*), 1) * 5 AS found, true AS reached FROM embeddings WHERE vec_id % 100 = 0""")
def _(spark, folder):
    """Recall at 5 of the approximate search, against all rows, for the requests whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    items = vectors.select(F.col("vec_id").alias("id"), "embedding")
    requests = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = C.build_cells(items)
    near = C.cell_search(index, requests, R.matches_filters(), probes=C.probes_for(index))
    exact = R.filtered_vector_search(items, requests, R.matches_filters())
    both = exact.select("query_id", "id").join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    each = both.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("requests"), F.max("n").alias("found"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("reached"))


@query("c05_single_request", """
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], [CAST(i AS DOUBLE) - 20 FOR i IN range(64)]), 6) AS score FROM embeddings WHERE label = 3
ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], [CAST(i AS DOUBLE) - 20 FOR i IN range(64)]), 9) DESC, vec_id LIMIT 5""")
def _(spark, folder):
    items = v6_items(spark, folder).select("id", "embedding", F.col("label").alias("career"), F.lit("Data AI").alias("duty"), F.lit("c, java").alias("it_language"))
    chosen = R.filter_items(items, duty="ai", career=3, degree=0, lists={"it_language": ["java", "go"], "tool": []})
    return R.nearest_to_vector(chosen, [i - 20.0 for i in range(64)]).select("id", F.round("score", 6).alias("score"))


@query("c06_nearest_context_rows", with_ctes(V6_SQL, body="""
SELECT query_id, string_agg('label: ' || label || chr(10) || 'item: ' || id || chr(10) || 'odd: ' || CASE WHEN id % 2 = 1 THEN 'yes' ELSE 'N/A' END, chr(10) || chr(10) ORDER BY place) AS context
FROM (SELECT query_id, query_id AS label, id, place FROM hits) GROUP BY query_id"""))
def _(spark, folder):
    hits = R.filtered_vector_search(v6_items(spark, folder), v6_queries(spark, folder), R.matches_filters(equal=["label"]))
    rows = hits.withColumn("label", F.col("query_id")).withColumn("odd", F.when(F.col("id") % 2 == 1, "yes"))
    return R.nearest_context_rows(rows, {"label": "label", "item": "id", "odd": "odd"})
