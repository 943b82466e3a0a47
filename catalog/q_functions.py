"""P: projections, filters, scalar functions."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    V1_SQL, V2_LISTS_SQL, V2_SQL, V2_STATS_SQL, V3_SQL, V7_SQL, table, v1_tokens, v2_skill_lists, v3, v7, with_ctes,
)
from postlens.functions import lists as L, text as X, tokens as K
from postlens.operators import distribution as A, joins as J
from postlens.plans.profiles import validate_profiles
from postlens.sources.dictionaries import spaced_synonyms
from postlens.sources.tables import drop_columns_if_present

STRIP = r"chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || ' '"


@query("p01_build_combined_text", """
SELECT doc_id, lower(replace(replace(concat_ws(' ', coalesce(source, ''), coalesce(text, ''), coalesce(lang, '')), '.', ''), '/', ', ')) AS combined_text FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.combined_text("source", "text", "lang").alias("combined_text"))


@query("p02_fill_blank_from_other", """
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN NULL ELSE source END, ''), url) AS source
FROM documents LEFT JOIN pages ON doc_id = page_id""")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    blanked = docs.select("doc_id", F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", None).otherwise(F.col("source")).alias("source"))
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"))
    return J.fill_blank_from_other(blanked, pages, "doc_id", ["source"])


@query("p03_drop_incomplete_rows", "SELECT event_id FROM events WHERE props IS NOT NULL AND props <> '' AND event_type NOT IN ('view', 'error')")
def _(spark, folder):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "error", None).otherwise(F.col("event_type"))
    rows = table(spark, folder, "events").withColumn("event_type", kind)
    return J.drop_incomplete_rows(rows, ["event_type", "props"]).select("event_id")


@query("p04_drop_columns_if_present", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, folder):
    return drop_columns_if_present(table(spark, folder, "supplier"), "s_nationkey", "s_acctbal", "no_such_column")


@query("p05_upper_country", "SELECT n_nationkey, upper(substr(lower(n_name), 1, 8)) AS code FROM nation")
def _(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", X.upper_country(F.lower(F.substring("n_name", 1, 8))).alias("code"))


@query("p06_parse_career_range", """
SELECT p_partkey, CAST(CASE p_size % 6 WHEN 2 THEN p_size WHEN 3 THEN p_size ELSE 0 END AS INTEGER) AS career,
  CAST(CASE p_size % 6 WHEN 1 THEN 1 WHEN 2 THEN p_size + 3 WHEN 3 THEN p_size ELSE 100 END AS INTEGER) AS max_career FROM part""")
def _(spark, folder):
    n, kind = F.col("p_size"), F.col("p_size") % 6
    text = (
        F.when(kind == 0, "경력 무관").when(kind == 1, "신입 환영")
        .when(kind == 2, F.concat(F.lit("경력 "), n.cast("string"), F.lit("~"), (n + 3).cast("string"), F.lit("년")))
        .when(kind == 3, F.concat(F.lit("경력 "), n.cast("string"), F.lit("년 이상"))).when(kind == 4, F.col("p_name"))
    )
    return table(spark, folder, "part").select("p_partkey", X.career_range(text).alias("r")).select("p_partkey", "r.career", "r.max_career")


REGIONS = (("east", "Th[eo]|Of"), ("west", "De|La"), ("north", "[Uu]nd"), ("south", "qu[ei]"))


@query("p07_extract_region", """
SELECT doc_id, CASE WHEN regexp_matches(text, 'Th[eo]|Of') THEN 'east' WHEN regexp_matches(text, 'De|La') THEN 'west'
  WHEN regexp_matches(text, '[Uu]nd') THEN 'north' WHEN regexp_matches(text, 'qu[ei]') THEN 'south' ELSE 'other' END AS region FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.extract_region("text", REGIONS, "other").alias("region"))


@query("p08_filter_latin_tokens", r"""
SELECT doc_id, CAST(len(kept) AS INTEGER) AS kept, array_to_string(kept, '|') AS tokens FROM (
  SELECT doc_id, [t FOR t IN string_split(text, ' ') IF regexp_full_match(t, '[a-zA-Z0-9#+\-\s]+')] AS kept FROM documents)""")
def _(spark, folder):
    kept = K.filter_latin(F.split("text", " "))
    return table(spark, folder, "documents").select("doc_id", F.size(kept).alias("kept"), F.array_join(kept, "|").alias("tokens"))


@query("p09_normalize_token", """
SELECT p_partkey, replace(replace(lower(p_brand || '. ' || p_name), '.', ''), ' ', '') AS token FROM part""")
def _(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.normalize_token(F.concat("p_brand", F.lit(". "), "p_name")).alias("token"))


@query("p10_code_to_label", with_ctes(V3_SQL, body="""
SELECT id, CASE language WHEN 1 THEN '영어' WHEN 2 THEN '일본어' WHEN 3 THEN '중국어' ELSE '무관' END AS language_label,
  CASE nullif(degree, 2) WHEN 0 THEN '무관/없음' WHEN 1 THEN '학사' WHEN 2 THEN '석사&박사' END AS degree_label FROM v3"""))
def _(spark, folder):
    degree = F.nullif(F.col("degree"), F.lit(2))
    return v3(spark, folder).select(
        "id", X.code_to_label("language", A.K.LANGUAGE_LABELS, A.K.NO_LANGUAGE_LABEL).alias("language_label"),
        X.code_to_label(degree, A.K.DEGREE_LABELS).alias("degree_label"),
    )


@query("p11_format_percent_text", with_ctes(V3_SQL, body="""
SELECT category, career, CAST(ratio AS VARCHAR) || '%' AS pct, format('{:.2f}%', ratio) AS pct2,
  CASE WHEN career = 0 THEN '신입사원' ELSE career || '년차' END AS career_label, career || '년차' AS year_label
FROM (SELECT category, career, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 2) AS ratio FROM v3d GROUP BY category, career)"""))
def _(spark, folder):
    return A.career_ratio(v3(spark, folder)).select(
        "category", "career", X.percent_text("ratio").alias("pct"), X.percent_text_2("ratio").alias("pct2"),
        X.career_label("career").alias("career_label"), X.year_label("career").alias("year_label"),
    )


@query("p12_substring_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR regexp_matches(p_name, '(?i)BLUE.*g')")
def _(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_name").filter(
        X.contains_ignore_case("p_name", "RiNg") | X.matches_ignore_case("p_name", "BLUE.*g")
    )


@query("p13_like_filter", with_ctes(V3_SQL, body="SELECT id FROM v3 WHERE duty ILIKE '%low%'"))
def _(spark, folder):
    return v3(spark, folder).filter(X.like_contains("duty", "low")).select("id")


@query("p14_list_overlap_filter", with_ctes(V2_SQL, V2_LISTS_SQL, body="SELECT id FROM lists WHERE list_has_any(skills, ['brand 3', 'brand 11'])"))
def _(spark, folder):
    rows = v2_skill_lists(spark, folder).select("id", F.array_join("skills", ", ").alias("cell"))
    return rows.filter(L.overlaps_list("cell", ["brand 3", "brand 11"]) & L.overlaps_list("cell", [])).select("id")


@query("p15_optional_equality_filter", with_ctes(V3_SQL, body="""
SELECT 'career 0' AS request, id FROM v3 WHERE career = 0 UNION ALL SELECT 'degree 1', id FROM v3 WHERE degree = 1
UNION ALL SELECT 'degree 0', id FROM v3 UNION ALL SELECT 'both', id FROM v3 WHERE career = 3 AND degree = 2"""))
def _(spark, folder):
    rows = v3(spark, folder)
    asked = {"career 0": (0, None), "degree 1": (None, 1), "degree 0": (None, 0), "both": (3, 2)}
    parts = [J.optional_equality(rows, c, d).select(F.lit(name).alias("request"), "id") for name, (c, d) in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("p16_parameter_in_filter", with_ctes(V2_SQL, body="""
SELECT 'list' AS request, count(*) AS n FROM v2 WHERE skill IN ('brand 1', 'brand 2')
UNION ALL SELECT 'table', count(*) FROM v2 WHERE skill IN (SELECT 'brand ' || n_nationkey FROM nation WHERE n_regionkey = 1)"""))
def _(spark, folder):
    from catalog.views import v2_rows

    rows = v2_rows(spark, folder).distinct()
    wanted = table(spark, folder, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("brand "), F.col("n_nationkey").cast("string")).alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("request"), "n")
    return count(J.keep_listed(rows, "skill", ["brand 1", "brand 2"]), "list").unionByName(count(J.keep_listed(rows, "skill", wanted), "table"))


@query("p17_wildcard_match_filter", """
WITH req AS (SELECT DISTINCT o_orderpriority AS grp, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey),
rowz AS (SELECT o_orderkey AS seq, o_orderpriority AS grp, o_orderstatus AS status, nullif(c_mktsegment, 'MACHINERY') AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT r.grp, r.status, r.segment, count(w.seq) AS matches, min(w.seq) AS first_seq FROM req r LEFT JOIN rowz w
  ON r.grp = w.grp AND w.status = coalesce(nullif(r.status, ''), w.status) AND w.segment = coalesce(nullif(r.segment, ''), w.segment)
GROUP BY r.grp, r.status, r.segment""")
def _(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"))
    blank = lambda c, v: F.when(F.col(c) == v, "").otherwise(F.col(c)).alias(c)
    requests = rows.select("grp", blank("status", "F"), blank("segment", "BUILDING")).distinct()
    stored = rows.withColumn("segment", F.nullif("segment", F.lit("MACHINERY")))
    return J.wildcard_match(requests, stored, "grp", ["status", "segment"], "seq")


SCHOOL = dict(bachelor=("qui", "sch"), school=("of", "la"), graduate=("and", "der"), higher=("the", "que"))


@query("p19_degree_requirement", with_ctes(V1_SQL, body="""
, t AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM v1),
g AS (SELECT doc_id, token, pos, max(CASE WHEN token IN ('of', 'la') THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS school FROM t),
h AS (SELECT DISTINCT doc_id FROM g WHERE token IN ('and', 'der') AND pos - school <= 10)
SELECT v1.doc_id, CASE WHEN list_has_any(tokens, ['qui', 'sch']) OR h.doc_id IS NOT NULL THEN 1
  WHEN list_has_any(tokens, ['the', 'que']) THEN 2 ELSE 0 END AS degree FROM v1 LEFT JOIN h ON v1.doc_id = h.doc_id""").replace("\n\n,", ",").replace("\n\n", "\n"))
def _(spark, folder):
    return v1_tokens(spark, folder).select("doc_id", K.degree_requirement("tokens", **SCHOOL).alias("degree"))


@query("p20_language_requirement", with_ctes(V1_SQL, body="""
SELECT v1.doc_id, code AS language FROM v1 LEFT JOIN (SELECT doc_id, arg_min(CASE token WHEN 'the' THEN 1 WHEN 'of' THEN 1 WHEN 'le' THEN 2 ELSE 3 END, pos) AS code
  FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM v1) WHERE token IN ('the', 'of', 'le', 'und') GROUP BY doc_id) c ON v1.doc_id = c.doc_id"""))
def _(spark, folder):
    codes = {"the": 1, "of": 1, "le": 2, "und": 3}
    return v1_tokens(spark, folder).select("doc_id", K.language_requirement("tokens", codes).alias("language"))


@query("p21_split_numbered_lines", f"""
SELECT doc_id, array_to_string([trim(CASE WHEN instr(x, '. ') > 0 THEN substr(x, instr(x, '. ') + 2) ELSE x END, {STRIP})
  FOR x IN regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') IF trim(x, {STRIP}) <> ''], '|') AS lines FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.split_numbered_lines("text"), "|").alias("lines"))


@query("p22_split_sentences_dash", f"""
SELECT doc_id, array_to_string([p FOR p IN [trim(x, {STRIP}) FOR x IN string_split(
  regexp_replace(replace(text, '- ', chr(1)), '(^|[^0-9])((?:\\.\\s+)+)', '\\1' || chr(1), 'g'), chr(1))] IF p <> ''], '|') AS sentences FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.split_sentences_dash("text"), "|").alias("sentences"))


@query("p23_split_numbered_inline", f"""
SELECT doc_id, array_to_string([p FOR p IN [trim(x, {STRIP}) FOR x IN regexp_split_to_array(text, '[0-9]+\\.\\s+')] IF p <> ''], '|') AS pieces FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.split_numbered_inline("text"), "|").alias("pieces"))


@query("p24_spaced_variant", with_ctes(V1_SQL, body="""
SELECT term, CASE WHEN term LIKE '%on' THEN substr(term, 1, length(term) - 2) || ' on' WHEN term LIKE '%tion' THEN 'never'
  ELSE substr(term, 1, length(term) - 3) || ' eux' END AS variant
FROM (SELECT DISTINCT unnest(tokens) AS term FROM v1) WHERE term LIKE '%on' OR term LIKE '%eux'"""))
def _(spark, folder):
    terms = v1_tokens(spark, folder).select(F.explode("tokens").alias("term")).distinct()
    return terms.withColumn("variant", X.spaced_variant("term", ("on", "tion", "eux"))).filter(F.col("variant").isNotNull())


@query("p24_spaced_synonyms", with_ctes(V1_SQL, body="""
SELECT term, regexp_replace(term, '(db|sql|js)$', ' \\1') AS variant
FROM (SELECT DISTINCT unnest(tokens) || ['db', 'sql', 'js', 'go'][doc_id % 4 + 1] AS term FROM v1) WHERE regexp_matches(term, '(db|sql|js)$')"""))
def _(spark, folder):
    from catalog.views import pick

    suffix = pick(F.col("doc_id") % 4, ["db", "sql", "js", "go"])
    terms = v1_tokens(spark, folder).select(F.explode("tokens").alias("t"), suffix.alias("s")).select(F.concat("t", "s").alias("term")).distinct()
    return spaced_synonyms(terms)


@query("p26_regex_row_filter", """
SELECT 'has' AS kind, p_partkey FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'lacks', p_partkey FROM part WHERE p_size % 4 > 0""")
def _(spark, folder):
    cell = F.concat(F.lit("('"), "p_name", F.lit("', '"), F.when(F.col("p_size") % 4 == 0, "O").otherwise("B-TOOL"), F.lit("')"))
    rows = table(spark, folder, "part").select("p_partkey", cell.alias("cell"))
    side = lambda negate, name: rows.filter(X.contains_text("cell", "'O'", negate)).select(F.lit(name).alias("kind"), "p_partkey")
    return side(False, "has").unionByName(side(True, "lacks"))


@query("p27_split_trim_lower_list", with_ctes(V2_SQL, V2_LISTS_SQL, body="""
SELECT id, CASE WHEN duty = '5-LOW' THEN '' ELSE array_to_string(skills, '|') END AS tags FROM lists"""))
def _(spark, folder):
    cell = F.when(F.col("duty") != "5-LOW", F.upper(F.array_join("skills", " ,  ")))
    return v2_skill_lists(spark, folder).select("id", F.array_join(L.split_trim_lower(cell), "|").alias("tags"))


@query("p28_validate_profiles", with_ctes(V7_SQL, body="""
SELECT k.profile_id, array_to_string(list_sort([k.duty]), ',') AS jobs, k.framework AS frameworks,
  CASE n_regionkey WHEN 0 THEN 'no job' WHEN 1 THEN 'more than one job' WHEN 2 THEN CASE WHEN k.tool <> '' THEN 'chosen twice' END END AS problem
FROM (SELECT profile_id, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN duty || ',x' ELSE duty END AS duty, n_regionkey FROM v7) v
JOIN (SELECT profile_id AS pid, framework, tool FROM pkeys) ON profile_id = pid, LATERAL (SELECT v.profile_id, coalesce(v.duty, '') AS duty, framework, tool) k"""))
def _(spark, folder):
    region = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("profile_id"), "n_regionkey")
    rows = v7(spark, folder).join(region, "profile_id").withColumn(
        "jobs", F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).when(
            F.col("n_regionkey") == 1, F.concat("jobs", F.array(F.lit("x")))).otherwise(F.col("jobs"))
    ).withColumn("devtools", F.when(F.col("n_regionkey") == 2, F.concat("devtools", "devtools")).otherwise(F.col("devtools")))
    out = validate_profiles(rows)
    return out.select("profile_id", F.array_join("jobs", ",").alias("jobs"), F.array_join("frameworks", ", ").alias("frameworks"), "problem")
