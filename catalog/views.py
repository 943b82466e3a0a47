"""Stand-in views on the given tables, for Spark and (as CTEs) for SQL.

V1 posting texts from ``documents``, V2 posting-skill rows from ``lineitem``/``part``/``orders``,
V3 categorised postings from ``orders``/``customer``, V4 ``pages``, V5 ``events``, V6
``embeddings`` with one request per label, V7 one profile per ``nation``, V8 tokens of
``conversations`` with a dictionary from ``benchmark``, V9 tag sequences from ``labels``.
All of them use every row of their tables.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.functions.tokens import words
from postlens.operators.skills import baskets_from_rows
from postlens.session import stored_bytes

CATEGORY_OF = ("it_language", "framework", "library", "tool")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
DUTY_NAMES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW",
              "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Weights of the stand-in duties, 5-LOW has none.
WEIGHTS = {
    "1-URGENT": (0.2, 0.25, 0.45, 0.1), "2-HIGH": (0.3, 0.45, 0.3, 0.15),
    "3-MEDIUM": (0.1, 0.4, 0.4, 0.1), "4-NOT SPECIFIED": (0.7, 0.1, 0.1, 0.1),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Stored bytes of a table whose rows one task sorts: about 150,000 orders or 600,000 line items.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, key: str, folder: str, name: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as the named table's size asks for, where the session has fewer.

    Joins and groups by that key keep the number, so what a task holds doesn't grow with the table.
    """
    tasks = stored_bytes(df.sparkSession, f"{folder}/{name}.parquet") // TASK_BYTES
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# ---- V1 ----
def v1_texts(spark, folder):
    return table(spark, folder, "documents")


def v1_tokens(spark, folder):
    return v1_texts(spark, folder).select("doc_id", "lang", "source", words("text").alias("tokens"))


V1_SQL = """v1 AS (SELECT doc_id, lang, source,
  regexp_extract_all(lower(text), '[a-z0-9#+]+') AS tokens FROM documents)"""


# ---- V2 ----
def v2_rows(spark, folder):
    brand = F.substring("p_brand", 7, 10).cast("int")
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "N").alias("required"))
    part = table(spark, folder, "part").select(
        "p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("skill"), pick(brand % 4, CATEGORY_OF).alias("category")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("duty"))
    named = spread(spread(line, "l_partkey", folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", folder, "lineitem")
    return (
        named.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("l_orderkey").alias("id"), "duty", "category", "skill", "required")
    )


def v2_baskets(spark, folder):
    return baskets_from_rows(v2_rows(spark, folder))


def v2_totals(spark, folder):
    """Postings per duty: orders with at least one line item."""
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        .groupBy(F.col("o_orderpriority").alias("duty")).agg(F.count("*").alias("total_jobs"))
    )


def v2_cells(spark, folder):
    """One row per posting with the joined distinct skills of each category, required and preferred."""
    rows = v2_rows(spark, folder)
    def cell(category, required):
        hit = (F.col("category") == category) & (F.col("required") == required)
        return F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("skill")))), ", ")
    cells = [cell(c, True).alias(c) for c in CATEGORY_OF] + [cell(c, False).alias("pre_" + c) for c in CATEGORY_OF]
    return rows.groupBy("id", "duty").agg(*cells)


def v2_skill_lists(spark, folder):
    """One row per posting with the sorted distinct skills."""
    return v2_rows(spark, folder).groupBy("id", "duty").agg(F.sort_array(F.collect_set("skill")).alias("skills"))


V2_SQL = """v2 AS (SELECT DISTINCT l.l_orderkey AS id, o.o_orderpriority AS duty,
  CASE CAST(substr(p.p_brand, 7) AS INTEGER) % 4 WHEN 0 THEN 'it_language' WHEN 1 THEN 'framework' WHEN 2 THEN 'library' ELSE 'tool' END AS category,
  lower(replace(p.p_brand, '#', ' ')) AS skill, l.l_returnflag = 'N' AS required
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
V2_TOTALS_SQL = "totals AS (SELECT duty, count(DISTINCT id) AS total_jobs FROM v2 GROUP BY duty)"
V2_STATS_SQL = f"""{V2_SQL}, {V2_TOTALS_SQL},
stats1 AS (SELECT v.duty, v.category, v.skill, 1 AS unit,
  100.0 * count(DISTINCT CASE WHEN required THEN id END) / any_value(t.total_jobs) AS probability,
  100.0 * count(DISTINCT CASE WHEN NOT required THEN id END) / any_value(t.total_jobs) AS pre_probability
  FROM v2 v JOIN totals t ON v.duty = t.duty GROUP BY v.duty, v.category, v.skill),
ranked AS (SELECT *, CAST(rank() OVER (PARTITION BY duty, category ORDER BY probability DESC, pre_probability DESC, skill) AS INTEGER) AS rank FROM stats1)"""
V2_SETS_SQL = """stats3 AS (SELECT a.duty, a.category, concat_ws(', ', a.skill, b.skill, c.skill) AS skill, 3 AS unit,
  100.0 * count(CASE WHEN a.required THEN 1 END) / any_value(t.total_jobs) AS probability,
  100.0 * count(CASE WHEN NOT a.required THEN 1 END) / any_value(t.total_jobs) AS pre_probability
  FROM v2 a JOIN v2 b ON a.id = b.id AND a.category = b.category AND a.required = b.required AND a.skill < b.skill
  JOIN v2 c ON a.id = c.id AND a.category = c.category AND a.required = c.required AND b.skill < c.skill
  JOIN totals t ON a.duty = t.duty GROUP BY a.duty, a.category, a.skill, b.skill, c.skill)"""
V2_LISTS_SQL = "lists AS (SELECT id, duty, list_sort(list(DISTINCT skill)) AS skills FROM v2 GROUP BY id, duty)"


# ---- V3 ----
def v3(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(", ", F.substring("o_orderpriority", 3, 100), "c_mktsegment").alias("duty"),
        (F.col("o_custkey") % 11).cast("int").alias("career"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("language"),
        (F.col("o_orderkey") % 3).cast("int").alias("degree"),
    )


V3_SQL = """v3 AS (SELECT o_orderkey AS id, concat_ws(', ', substr(o_orderpriority, 3), c_mktsegment) AS duty,
  CAST(o_custkey % 11 AS INTEGER) AS career, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS language,
  CAST(o_orderkey % 3 AS INTEGER) AS degree FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
names AS (SELECT unnest(['URGENT','HIGH','MEDIUM','NOT SPECIFIED','LOW','AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS category),
v3d AS (SELECT n.category, v.* FROM v3 v JOIN names n ON v.duty ILIKE '%' || n.category || '%')"""


# ---- V6 ----
def v6_items(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def v6_queries(spark, folder):
    """One request per label: the mean vector of its items."""
    means = (
        v6_items(spark, folder).select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")
    ).select(F.col("label").alias("query_id"), "label", "vector")


V6_SQL = """means AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos,
  unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos),
queries AS (SELECT label AS query_id, label, list(x ORDER BY pos) AS vector FROM means GROUP BY label),
scored AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS score
  FROM embeddings e JOIN queries q ON e.label = q.label),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM scored) WHERE place <= 5)"""


# ---- V7 ----
def v7(spark, folder):
    """One profile per nation: a duty, and the skills whose number lies 0, 1, 4 or 8 above its own."""
    key = F.col("n_nationkey")
    numbers = F.array(*[(key + d) % 25 + 1 for d in (0, 1, 4, 8)])
    def chosen(i):
        return F.sort_array(F.transform(F.filter(numbers, lambda n: n % 4 == i), lambda n: F.concat(F.lit("brand "), n.cast("string"))))
    return table(spark, folder, "nation").select(
        key.cast("bigint").alias("profile_id"), chosen(0).alias("languages"), chosen(1).alias("frameworks"),
        chosen(2).alias("libraries"), chosen(3).alias("devtools"), F.array(pick(key % 5, PRIORITIES)).alias("jobs"),
    )


V7_SQL = """v7 AS (SELECT CAST(n_nationkey AS BIGINT) AS profile_id,
  ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][n_nationkey % 5 + 1] AS duty, n_regionkey FROM nation),
own AS (SELECT DISTINCT profile_id, duty, 'brand ' || num AS skill,
  ['it_language','framework','library','tool'][num % 4 + 1] AS category
  FROM (SELECT profile_id, duty, unnest([profile_id % 25 + 1, (profile_id + 1) % 25 + 1, (profile_id + 4) % 25 + 1, (profile_id + 8) % 25 + 1]) AS num FROM v7)),
cats AS (SELECT unnest(['it_language','framework','library','tool']) AS category),
groups AS (SELECT v.profile_id, v.duty, c.category, coalesce(list_sort(list(o.skill) FILTER (o.skill IS NOT NULL)), []) AS owned
  FROM v7 v CROSS JOIN cats c LEFT JOIN own o ON o.profile_id = v.profile_id AND o.category = c.category GROUP BY ALL),
pkeys AS (SELECT profile_id, duty,
  max(CASE WHEN category = 'it_language' THEN array_to_string(owned, ', ') END) AS it_language,
  max(CASE WHEN category = 'framework' THEN array_to_string(owned, ', ') END) AS framework,
  max(CASE WHEN category = 'library' THEN array_to_string(owned, ', ') END) AS library,
  max(CASE WHEN category = 'tool' THEN array_to_string(owned, ', ') END) AS tool FROM groups GROUP BY profile_id, duty)"""


# ---- V8 ----
def v8_tokens(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", words("text").alias("tokens"))


def v8_dictionary(spark, folder):
    """Distinct benchmark tokens, category by length."""
    token = table(spark, folder, "benchmark").select(F.explode(words("text")).alias("name")).distinct()
    return token.select(
        pick(F.length("name") % 4, ("languages", "frameworks", "libraries", "tools")).alias("category"), "name"
    )


V8_SQL = """v8 AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9#+]+') AS tokens FROM conversations),
dict AS (SELECT DISTINCT ['languages','frameworks','libraries','tools'][length(name) % 4 + 1] AS category, name
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9#+]+')) AS name FROM benchmark)),
tok AS (SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM v8),
tagged AS (SELECT t.*, CASE WHEN d.category IS NULL THEN 'O' ELSE 'B-' || upper(d.category) END AS tag
  FROM tok t LEFT JOIN dict d ON t.token = d.name)"""


# ---- V9 ----
def v9(spark, folder):
    """Tag sequences of ten documents each; an I tag follows a non-O tag where the position allows."""
    from pyspark.sql import Window

    rows = table(spark, folder, "labels").select(
        F.expr("doc_id div 10").alias("seq"), F.col("doc_id").alias("pos"),
        F.when(F.col("quality") == 1, "B-X").otherwise("O").alias("g"), F.when(F.col("toxic") == 0, "B-X").otherwise("O").alias("p"),
    )
    near = Window.partitionBy("seq").orderBy("pos")
    def tag(c):
        inside = (F.col(c) != "O") & (F.lag(c).over(near) != "O") & (F.col("pos") % 3 == 1)
        return F.when(inside, "I-X").otherwise(F.col(c))
    tagged = rows.select("seq", "pos", tag("g").alias("gold"), tag("p").alias("predicted"))
    return tagged.withColumn("pos", F.row_number().over(near))


V9_SQL = """l9 AS (SELECT doc_id // 10 AS seq, doc_id AS pos0, CASE WHEN quality = 1 THEN 'B-X' ELSE 'O' END AS g,
  CASE WHEN toxic = 0 THEN 'B-X' ELSE 'O' END AS p FROM labels),
v9 AS (SELECT seq, row_number() OVER w AS pos,
  CASE WHEN g <> 'O' AND lag(g) OVER w <> 'O' AND pos0 % 3 = 1 THEN 'I-X' ELSE g END AS gold,
  CASE WHEN p <> 'O' AND lag(p) OVER w <> 'O' AND pos0 % 3 = 1 THEN 'I-X' ELSE p END AS predicted
  FROM l9 WINDOW w AS (PARTITION BY seq ORDER BY pos0))"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
