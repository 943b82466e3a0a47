"""S and J: sources, sinks, raw JSON, list-shaped text."""

from pyspark.sql import Window, functions as F, types as T

from catalog.registry import query
from catalog.views import V2_LISTS_SQL, V2_SQL, V8_SQL, pick, spread, table, v2_skill_lists, v8_tokens, with_ctes
from postlens.functions import lists as L, text as X
from postlens.operators import keyed
from postlens.session import scratch_path
from postlens.sources import dictionaries as D, json_docs, tables


@query("s01_s02_csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "csv")
    tables.write_csv_table(docs, path, docs.columns)
    return tables.read_csv_table(spark, path, docs.schema)


@query("s02_write_csv_table", "SELECT doc_id, source FROM documents")
def _(spark, folder):
    """Chosen columns only."""
    path = scratch_path(spark, "csv")
    tables.write_csv_table(table(spark, folder, "documents"), path, ["source", "doc_id"])
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("doc_id", T.LongType())])
    return tables.read_csv_table(spark, path, schema)


@query("s03_scan_relational_tables", """
SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def _(spark, folder):
    tables.scan_tables(spark, folder, ["nation", "customer"])
    return spark.sql(
        "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"
    )


@query("s04_scan_raw_json_text", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, folder):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    docs = json_docs.scan_raw_json_text(table(spark, folder, "events"), schema, "props")
    return docs.select("event_id", F.col("doc.k").alias("k"))


# ---- raw documents of the first feed, built from orders and their skills ----
def raw_a(spark, folder):
    o = table(spark, folder, "orders").join(v2_skill_lists(spark, folder).select("id", "skills"), F.col("o_orderkey") == F.col("id"))
    years = (F.col("o_custkey") % 7).cast("string")
    career = (
        F.when(F.col("o_custkey") % 5 == 0, "경력 무관").when(F.col("o_custkey") % 5 == 1, "신입")
        .when(F.col("o_custkey") % 5 == 2, F.concat(F.lit("경력 "), years, F.lit(" ~ "), (F.col("o_custkey") % 7 + 3).cast("string"), F.lit("년")))
        .when(F.col("o_custkey") % 5 == 3, F.concat(F.lit("경력 "), years, F.lit("년 이상"))).otherwise("협의")
    )
    ids = F.when(F.col("o_custkey") % 13 == 0, F.array(F.lit(999), F.lit(4))).when(
        F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(1), F.lit(25))
    ).otherwise(F.array(F.lit(158)))
    tags = F.transform("skills", lambda s: F.struct(s.alias("name")))
    body = F.struct(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/job/"), F.col("o_orderkey").cast("string"))).alias("url"),
        career.alias("career"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("title"),
        pick(F.col("o_orderkey") % 4, ["서울 강남구", "전라북도 전주시", "부산 해운대구", "Somewhere"]).alias("address"),
        ids.alias("jobCategoryIds"), tags.alias("technicalTags"), F.lit("KR").alias("countryCode"),
        F.concat(F.lit("<h3>자격 요건</h3><ul><li>"), F.array_join("skills", "</li><li>"), F.lit("</li></ul>")).alias("description"),
        F.lit("").alias("requirement"), F.col("o_orderpriority").alias("preferredExperience"),
        F.struct(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name")).alias("company"),
    )
    text = F.to_json(F.struct(body.alias("jobPosition")))
    low = F.col("o_orderpriority") == "5-LOW"
    damaged = F.when(low & (F.col("o_orderstatus") == "P"), F.substring(text, F.lit(1), F.length(text) - 5)).when(
        low & (F.col("o_orderstatus") == "O"), F.lit('{"other": 1}')
    ).otherwise(text)
    return o.select(F.col("o_orderkey").alias("row_id"), damaged.alias("text"))


RAW_A_SQL = f"""{V2_SQL}, {V2_LISTS_SQL}, a AS (SELECT o.*, skills, o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS broken, o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AS rootless
  FROM orders o JOIN lists ON o_orderkey = id)"""
CAREER_SQL = """CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN o_custkey % 7 WHEN 3 THEN o_custkey % 7 ELSE 0 END"""
MAX_CAREER_SQL = """CASE o_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN o_custkey % 7 + 3 WHEN 3 THEN o_custkey % 7 ELSE 100 END"""
REGION_SQL = "['서울','전북','부산','기타'][o_orderkey % 4 + 1]"


@query("j01_flatten_posting_json_a", with_ctes(RAW_A_SQL, body=f"""
SELECT o_orderkey AS id, 'https://career.programmers.co.kr' || CASE WHEN o_orderstatus <> 'P' THEN '/job/' || o_orderkey ELSE '' END AS url,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE '' END AS title, {REGION_SQL} AS location,
  CASE WHEN o_custkey % 13 = 0 THEN '프론트엔드' WHEN o_orderpriority = '1-URGENT' THEN '서버/백엔드, 웹 풀스택' ELSE '데이터 분석' END AS duty,
  array_to_string(skills, ', ') AS "technicalTags", 'KR' AS "countryCode", '' AS requirement, 'Customer ' || o_custkey AS company_name,
  CAST({CAREER_SQL} AS INTEGER) AS career, CAST({MAX_CAREER_SQL} AS INTEGER) AS max_career
FROM a WHERE NOT broken AND NOT rootless"""))
def _(spark, folder):
    flat = json_docs.with_career_and_region(json_docs.flatten_posting_json_a(raw_a(spark, folder)))
    return flat.select("id", "url", "title", "location", "duty", "technicalTags", "countryCode", "requirement",
                       "company_name", "career", "max_career")


@query("j01_unknown_ids", with_ctes(RAW_A_SQL, body="""
SELECT CAST(999 AS INTEGER) AS category_id, count(*) AS postings FROM a WHERE NOT broken AND NOT rootless AND o_custkey % 13 = 0 HAVING count(*) > 0"""))
def _(spark, folder):
    return json_docs.unknown_category_ids(raw_a(spark, folder))


@query("j02_flatten_posting_json_b", with_ctes(V2_SQL, V2_LISTS_SQL, body="""
SELECT o_orderkey AS id, 'https://www.wanted.co.kr/wd/' || o_orderkey AS url, o_orderpriority AS title, n_name AS location,
  CASE WHEN o_orderstatus <> 'P' THEN 'seg, ' || o_orderstatus END AS duty, array_to_string(skills, ', ') AS "technicalTags",
  upper(substr(n_name, 1, 3)) AS "countryCode", c_name AS company_name, CAST(o_custkey % 11 AS INTEGER) AS career
FROM orders JOIN lists ON o_orderkey = id JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""))
def _(spark, folder):
    return json_docs.flatten_posting_json_b(raw_b(spark, folder)).select(
        "id", "url", "title", "location", "duty", "technicalTags", "countryCode", "company_name", "career"
    )


def raw_b(spark, folder):
    # The customers first: rows that carry their skills already aren't dealt and sorted by customer.
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", folder, "lineitem")
    rows = (
        orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(v2_skill_lists(spark, folder).select("id", "skills"), F.col("o_orderkey") == F.col("id"))
    )
    named = lambda c: F.struct(c.alias("text"))
    children = F.when(F.col("o_orderstatus") != "P", F.array(named(F.lit("seg")), named(F.col("o_orderstatus")))).otherwise(
        F.array().cast("array<struct<text:string>>")
    )
    job = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_orderpriority").alias("position"), F.lit("do").alias("main_tasks"),
                 F.array_join("skills", ", ").alias("requirements"), F.col("o_orderpriority").alias("preferred_points")).alias("detail"),
        F.struct(F.col("n_name").alias("location"), F.lower(F.substring("n_name", 1, 3)).alias("country_code")).alias("address"),
        F.struct(children.alias("child_tags")).alias("category_tag"),
        F.transform("skills", lambda s: named(s)).alias("skill_tags"), F.struct(F.col("c_name").alias("name")).alias("company"),
        (F.col("o_custkey") % 11).cast("int").alias("annual_from"),
    )
    return rows.select(F.to_json(F.struct(job.alias("job"))).alias("text"))


@query("j03_skip_bad_json", with_ctes(RAW_A_SQL, body="SELECT o_orderkey AS row_id FROM a WHERE NOT broken AND NOT rootless"))
def _(spark, folder):
    return json_docs.skip_bad_json(raw_a(spark, folder), "jobPosition").select("row_id")


@query("j03_rejected_rows", with_ctes(RAW_A_SQL, body="""
SELECT o_orderkey AS row_id, CASE WHEN broken THEN 'not JSON' WHEN rootless THEN 'no root' ELSE 'kept' END AS channel FROM a"""))
def _(spark, folder):
    kept, rejected = json_docs.divert_bad_json(raw_a(spark, folder), "jobPosition", scratch_path(spark, "json-rows"))
    return kept.select("row_id", F.lit("kept").alias("channel")).unionByName(rejected.select("row_id", F.col("reason").alias("channel")))


@query("j04_default_missing_fields", with_ctes(RAW_A_SQL, body="""
SELECT o_orderkey AS row_id, CASE WHEN rootless OR o_orderstatus = 'F' THEN '제목 없음' ELSE o_orderpriority END AS title,
  CASE WHEN rootless THEN '회사명 없음' ELSE 'Customer ' || o_custkey END AS company,
  CASE WHEN rootless OR o_orderstatus = 'P' THEN 'URL 없음' ELSE 'https://career.programmers.co.kr/job/' || o_orderkey END AS url,
  CASE WHEN rootless THEN '' ELSE array_to_string(skills, ' ') END AS skills, '마감 기한 없음' AS deadline
FROM a WHERE NOT broken"""))
def _(spark, folder):
    return json_docs.serving_rows(raw_a(spark, folder))


@query("j05_join_struct_array_names", with_ctes(V2_SQL, V2_LISTS_SQL, body="""
SELECT id, array_to_string(skills, ', ') AS comma_names, array_to_string(skills, ' ') AS space_names FROM lists"""))
def _(spark, folder):
    rows = v2_skill_lists(spark, folder).withColumn("tags", F.transform("skills", lambda s: F.struct(s.alias("name"))))
    return rows.select("id", L.join_names("tags").alias("comma_names"), L.join_names("tags", sep=" ").alias("space_names"))


@query("j06_map_id_array_to_names", """
WITH n AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey % 30 ORDER BY l_partkey % 30) AS ids FROM lineitem GROUP BY l_orderkey),
m AS (SELECT MAP {1:'서버/백엔드',2:'안드로이드',3:'iOS',4:'프론트엔드',5:'머신러닝',6:'블록체인',7:'모바일 게임',9:'시스템/네트워크',10:'QA',11:'인공지능(AI)',
12:'데이터 엔지니어링',13:'사물인터넷(IoT)',16:'게임 클라이언트',17:'응용 프로그램',18:'시스템 소프트웨어',20:'게임 서버',22:'인터넷 보안',25:'웹 풀스택',26:'임베디드 소프트웨어',27:'로보틱스 미들웨어'} AS names)
SELECT id, array_to_string([names[i] FOR i IN ids IF names[i] IS NOT NULL], ', ') AS duty,
  CAST(len([i FOR i IN ids IF names[i] IS NULL]) AS INTEGER) AS unknown FROM n, m""")
def _(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_set((F.col("l_partkey") % 30).cast("int"))).alias("ids")
    )
    return rows.select("id", L.ids_to_names("ids").alias("duty"), L.unknown_ids("ids").alias("unknown"))


@query("j07_build_url", """
SELECT page_id, 'https://x' || regexp_replace(url, '^https?://[^/]*', '') AS full_url, 'https://www.wanted.co.kr/wd/' || page_id AS id_url FROM pages""")
def _(spark, folder):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    return table(spark, folder, "pages").select(
        "page_id", X.build_url(path, "https://x").alias("full_url"), X.url_from_id("page_id").alias("id_url")
    )


@query("j08_extract_url_number", r"""
SELECT page_id, regexp_extract_all(url, '\d+')[1] AS first_number, regexp_extract_all(url, '\d+')[-1] AS last_number FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.url_number("url", "first").alias("first_number"), X.url_number("url", "last").alias("last_number")
    )


def _quoted(spark, folder):
    rows = v2_skill_lists(spark, folder)
    text = F.concat(F.lit("['"), F.array_join("skills", "', '"), F.lit("']"))
    return rows.select("id", F.when(F.col("duty") == "5-LOW", F.array_join("skills", ", ")).otherwise(text).alias("cell"))


@query("j09_parse_list_literal", with_ctes(V2_SQL, V2_LISTS_SQL, body="""
SELECT id, array_to_string(skills, '|') AS items FROM lists WHERE duty <> '5-LOW'"""))
def _(spark, folder):
    rows = _quoted(spark, folder).withColumn("items", L.parse_list_literal("cell")).filter(F.col("items").isNotNull())
    return rows.select("id", F.array_join("items", "|").alias("items"))


@query("j10_parse_tuple_literal", """
SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS tag, CASE WHEN p_size % 3 > 0 THEN 'B-' || p_type END AS ner_label FROM part""")
def _(spark, folder):
    tuple_text = F.concat(F.lit("('"), "p_name", F.lit("', 'B-"), "p_type", F.lit("')"))
    cell = F.when(F.col("p_size") % 3 > 0, tuple_text).otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", L.parse_tuple_literal(cell).alias("t")).select("p_partkey", "t.tag", "t.ner_label")


@query("j11_explode_list_column", with_ctes(V2_SQL, body="SELECT DISTINCT id, skill FROM v2 WHERE duty <> '5-LOW'"))
def _(spark, folder):
    rows = _quoted(spark, folder).withColumn("items", L.parse_list_literal("cell"))
    return rows.select("id", F.explode("items").alias("skill")).filter(F.col("skill").isNotNull())


@query("j12_list_to_json_string", with_ctes(V8_SQL, body="""
SELECT conv_id, turn, CASE WHEN len(tokens) = 0 THEN '[]' ELSE '["' || array_to_string(tokens, '","') || '"]' END AS tokens_json FROM v8"""))
def _(spark, folder):
    return v8_tokens(spark, folder).select("conv_id", "turn", L.list_to_json("tokens").alias("tokens_json"))


# ---- dictionaries ----
@query("s05_scan_term_list", r"""
SELECT lower(replace(line, '.', '')) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)""")
def _(spark, folder):
    path = scratch_path(spark, "terms")
    table(spark, folder, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return D.scan_term_list(spark, path)


def _synonym_rows(spark, folder):
    order = F.dense_rank().over(Window.partitionBy("category", "canonical").orderBy("synonym"))
    rows = table(spark, folder, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("canonical"), F.lower("p_brand").alias("synonym"))
    return rows.distinct().withColumn("pos", (order - 1).cast("int"))


SYNONYM_SQL = """syn AS (SELECT category, canonical, synonym, CAST(row_number() OVER (PARTITION BY category, canonical ORDER BY synonym) - 1 AS INTEGER) AS pos
  FROM (SELECT DISTINCT p_type AS category, p_name AS canonical, lower(p_brand) AS synonym FROM part))"""


@query("s06_s07_synonym_json_round_trip", with_ctes(SYNONYM_SQL, body="SELECT category, canonical, pos, synonym FROM syn"))
def _(spark, folder):
    documents = D.synonym_json(_synonym_rows(spark, folder))
    return D.flatten_synonym_json(documents)


@query("s07_write_synonym_json", with_ctes(SYNONYM_SQL, body="""
SELECT category, '{"' || category || '":{' || string_agg('"' || canonical || '":["' || items || '"]', ',' ORDER BY canonical) || '}}' AS value
FROM (SELECT category, canonical, string_agg(synonym, '","' ORDER BY pos) AS items FROM syn GROUP BY category, canonical) GROUP BY category"""))
def _(spark, folder):
    return D.synonym_json(_synonym_rows(spark, folder))


@query("h10_merge_synonym_dictionaries", with_ctes(SYNONYM_SQL, body="""
SELECT category, canonical, pos, synonym FROM syn UNION ALL
SELECT category, canonical, CAST(max(pos) + 1 AS INTEGER) AS pos, canonical || ' x' AS synonym FROM syn GROUP BY category, canonical"""))
def _(spark, folder):
    base = _synonym_rows(spark, folder)
    known = base.select("category", "canonical", F.concat("canonical", F.lit(" x")).alias("synonym")).distinct()
    unknown = known.select(F.concat(F.lit("no "), "category").alias("category"), "canonical", "synonym")
    return D.merge_synonym_dictionaries(base, known.unionByName(unknown)).select("category", "canonical", "pos", "synonym")


@query("h11_category_names", """
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY name) - 1 AS INTEGER) AS pos, name FROM (SELECT DISTINCT p_type AS category, trim(p_name) AS name FROM part)""")
def _(spark, folder):
    return D.category_names(table(spark, folder, "part"), "p_type", "p_name")


@query("h11_dictionary_by_category", """
SELECT p_type AS category, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT DISTINCT p_type, trim(p_name) AS name FROM part) GROUP BY p_type""")
def _(spark, folder):
    rows = D.dictionary_by_category(table(spark, folder, "part"), "p_type", "p_name")
    return rows.select(F.col("p_type").alias("category"), F.array_join("names", "|").alias("names"))


@query("s08_write_list_columns", with_ctes(V2_SQL, V2_LISTS_SQL, body="SELECT id, array_to_string(skills, ', ') AS skills FROM lists"))
def _(spark, folder):
    path = scratch_path(spark, "lists")
    tables.write_list_columns(v2_skill_lists(spark, folder), path, "id", ["skills"])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("skills", T.StringType())])
    return tables.read_csv_table(spark, path, schema)


# ---- keyed tables ----
@query("s09_upsert_by_key", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL
SELECT c_custkey, 'new ' || c_name, c_acctbal + 2 FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT c_custkey + 1000000000, 'added', 1.0 FROM customer WHERE c_acctbal < 0""")
def _(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("version"))
    low = rows.filter("c_acctbal < 0")
    step = lambda n: low.select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + n).alias("c_acctbal"), F.lit(n).alias("version"))
    added = low.select((F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit("added").alias("c_name"), F.lit(1.0).alias("c_acctbal"), F.lit(1).alias("version"))
    changes = step(1).unionByName(step(2)).unionByName(added)
    return keyed.upsert_by_key(rows, changes, ["c_custkey"], "version").drop("version")


@query("s10_update_column_from_table", """
SELECT s_suppkey, s_nationkey, coalesce(last_name, s_name) AS s_name FROM supplier LEFT JOIN
(SELECT c_nationkey + 3 AS c_nationkey, arg_max(c_name, c_custkey) AS last_name FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""")
def _(spark, folder):
    target = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"), "s_name")
    source = table(spark, folder, "customer").select((F.col("c_nationkey") + 3).alias("key"), "c_name", "c_custkey")
    return keyed.update_column_from_table(target, source, "key", "s_name", "c_name", "c_custkey").withColumnRenamed("key", "s_nationkey")


@query("s11_clear_column", "SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier")
def _(spark, folder):
    return keyed.clear_column(table(spark, folder, "supplier"), "s_acctbal").select("s_suppkey", "s_name", "s_acctbal")


@query("s12_append_with_next_id", """
SELECT o_orderkey AS seq, o_totalprice FROM orders UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderdate, o_orderkey), o_totalprice FROM orders""")
def _(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("seq"), "o_totalprice")
    new = table(spark, folder, "orders").select("o_totalprice", "o_orderdate", "o_orderkey")
    return keyed.append_with_next_id(rows, new, ["o_orderdate", "o_orderkey"])


@query("s13_update_list_cell", """
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'path|' || p_brand ELSE 'path' END AS new_path,
  CASE WHEN p_size % 3 = 0 THEN 'text' ELSE p_name || '|text' END AS new_text FROM part""")
def _(spark, folder):
    cell = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(
        F.col("p_size") % 3 == 1, F.array("p_name")).otherwise(F.array("p_name", "p_brand"))
    target = table(spark, folder, "part").select("p_partkey", cell.alias("a"), cell.alias("b"))
    source = target.select("p_partkey", F.lit("path").alias("path"), F.lit("text").alias("text"))
    out = keyed.update_list_cell(target, source, "p_partkey", "a", path="path")
    out = keyed.update_list_cell(out, source, "p_partkey", "b", text="text")
    return out.select("p_partkey", F.array_join("a", "|").alias("new_path"), F.array_join("b", "|").alias("new_text"))
