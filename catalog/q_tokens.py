"""H: HTML and text."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import V1_SQL, V2_SQL, V3_SQL, V8_SQL, table, v1_tokens, v2_cells, v3, v8_dictionary, with_ctes
from postlens.functions.html import html_sections, strip_html
from postlens.operators import tokens as T
from postlens.sources import dictionaries as D

def both_ways(name, sql):
    """Register a query with the dictionary looked up in the row, and with it joined."""
    def add(fn):
        query(name, sql)(fn)
        query(name.split("_")[0] + "_joined", sql)(lambda spark, folder: fn(spark, folder, max_entries=0))
        return fn

    return add


CATS = ("languages", "frameworks", "libraries", "tools")


def posting_pages(spark, folder):
    """A posting page per order, with its skills under headings."""
    def section(heading, cell, tag):
        items = F.array_join(F.transform(F.split(cell, ", "), lambda s: F.concat(F.lit("<li> "), s, F.lit(" &amp;</li>"))), "\n")
        return F.concat(F.lit(f"<{tag}>{heading}</{tag}><p>intro</p><ul>"), items, F.lit("</ul>"))

    html = F.concat(
        F.lit("<div><h2>주요 업무</h2><ul><li>"), "duty", F.lit("</li></ul>"), section("[자격 요건]", F.col("framework"), "h3"),
        F.lit("<!-- <ul><li>x</li></ul> -->"), section("우대사항", F.col("pre_framework"), "strong"), F.lit("<h3>우대 조건</h3></div>"),
    )
    return v2_cells(spark, folder).select("id", html.alias("html"))


@query("h01_html_sections", with_ctes(V2_SQL, body="""
SELECT id, any_value(duty) AS description, coalesce(string_agg(CASE WHEN required AND category = 'framework' THEN skill || ' &' END, '' ORDER BY skill), '&') AS requirement,
  coalesce(string_agg(CASE WHEN NOT required AND category = 'framework' THEN skill || ' &' END, '' ORDER BY skill), '&') AS "preferredExperience"
FROM v2 GROUP BY id"""))
def _(spark, folder):
    return posting_pages(spark, folder).select("id", html_sections("html").alias("s")).select("id", "s.*")


@query("h01_html_sections_of_pages")
def _(spark, folder):
    groups = (("titles", ("the", "The")), ("links", ("de", "un")))
    sections = html_sections("html", groups, tags=("h1", "li", "b"), target="p")
    return table(spark, folder, "pages").select("page_id", sections.alias("s")).select("page_id", "s.*")


@query("h02_strip_html", r"""
WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<x>', 'g') AS html FROM pages)
SELECT page_id, array_to_string([trim(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13))
  FOR x IN regexp_split_to_array(html, '<[^>]*>')], '') AS text FROM c""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", strip_html("html").alias("text"))


H03_SQL = (with_ctes(V1_SQL, body=r"""
SELECT doc_id, array_to_string([t FOR t IN [replace(replace(m, '||', ' '), '|', '') FOR m IN regexp_extract_all('|' || array_to_string(tokens, '||') || '|',
  '\|of\|\|the\|\|and\||\|of\|\|the\||\|the\|\|and\||\|to\|\|the\||\|de\|\|la\||\|[a-z0-9#+]+\|')] IF t NOT IN ('le', 'und', 'to the')], '/') AS tokens FROM v1"""))


def tokenized(spark, folder, **options):
    terms = spark.createDataFrame([("of the",), ("the and",), ("Of the and",), ("to the",), ("de la",), ("single",)], "term string")
    out = T.dictionary_tokenize(table(spark, folder, "documents").select("doc_id", "text"), "text", terms, ("le", "und", "to the"), **options)
    return out.select("doc_id", F.array_join("tokens", "/").alias("tokens"))


@query("h03_dictionary_tokenize", H03_SQL)
def _(spark, folder):
    return tokenized(spark, folder)


@query("h03_joined", H03_SQL)
def _(spark, folder):
    return tokenized(spark, folder, max_entries=0)


@both_ways("h04_replace_synonyms", with_ctes(V1_SQL, V8_SQL, body="""
SELECT v1.doc_id, coalesce(joined, '') AS tokens FROM v1 LEFT JOIN (
  SELECT doc_id, string_agg(coalesce('<' || upper(d.name) || '>', t.token), ' ' ORDER BY pos) AS joined
  FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM v1) t LEFT JOIN dict d ON t.token = d.name GROUP BY doc_id) j ON v1.doc_id = j.doc_id"""))
def _(spark, folder, **options):
    replacements = v8_dictionary(spark, folder).select(F.col("name").alias("key"), F.concat(F.lit("<"), F.upper("name"), F.lit(">")).alias("value"))
    rows = v1_tokens(spark, folder).select("doc_id", "tokens")
    return T.replace_tokens(rows, "tokens", replacements, **options).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("h05_build_synonym_dictionary", """
WITH k AS (SELECT p_partkey AS seq, CASE WHEN p_type = 'PROMO' THEN 'it_language' ELSE p_type END AS category, lower(p_brand) AS name,
  unnest([lower(p_brand)] || string_split(p_name, ' ')) AS key, generate_subscripts([lower(p_brand)] || string_split(p_name, ' '), 1) AS pos FROM part)
SELECT category, key, arg_max(name, seq * 100 + pos) AS name FROM k GROUP BY category, key""")
def _(spark, folder):
    elements = table(spark, folder, "part").select(
        F.col("p_partkey").alias("seq"), F.when(F.col("p_type") == "PROMO", " Language").otherwise(F.col("p_type")).alias("category"),
        F.lower("p_brand").alias("name"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("synonym"),
    )
    return D.build_synonym_dictionary(elements)


@query("h05_replacement_map", """
WITH k AS (SELECT p_partkey AS seq, lower(p_brand) AS name, unnest(string_split(lower(p_name), ' ')) AS key,
  generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)
SELECT key, arg_max(name, seq * 100 + pos) AS value FROM k GROUP BY key""")
def _(spark, folder):
    elements = table(spark, folder, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "p_brand").alias("name"), F.replace(F.upper("p_name"), F.lit(" "), F.lit(",")).alias("synonym"))
    return D.replacement_map(elements)


@both_ways("h06_classify_tokens_multi", with_ctes(V1_SQL, V8_SQL, body="""
SELECT v1.doc_id, coalesce(languages, '') AS languages, coalesce(frameworks, '') AS frameworks, coalesce(libraries, '') AS libraries, coalesce(tools, '') AS tools
FROM v1 LEFT JOIN (SELECT doc_id, string_agg(name, ', ' ORDER BY name) FILTER (category = 'languages') AS languages,
  string_agg(name, ', ' ORDER BY name) FILTER (category = 'frameworks') AS frameworks, string_agg(name, ', ' ORDER BY name) FILTER (category = 'libraries') AS libraries,
  string_agg(name, ', ' ORDER BY name) FILTER (category = 'tools') AS tools
  FROM (SELECT DISTINCT doc_id, e.category, e.name FROM (SELECT doc_id, unnest(tokens) AS token FROM v1) t JOIN
    (SELECT category, name AS key, substr(name, 1, 4) AS name FROM dict UNION ALL SELECT 'tools', name, 'long' FROM dict WHERE length(name) > 7) e ON t.token = e.key) GROUP BY doc_id) j
ON v1.doc_id = j.doc_id"""))
def _(spark, folder, **options):
    base = v8_dictionary(spark, folder)
    both = base.select("category", F.col("name").alias("key"), F.substring("name", 1, 4).alias("name")).unionByName(
        base.filter(F.length("name") > 7).select(F.lit("tools").alias("category"), F.col("name").alias("key"), F.lit("long").alias("name")))
    return T.classify_tokens_multi(v1_tokens(spark, folder).select("doc_id", "tokens"), "tokens", both, CATS, **options).drop("tokens")


@both_ways("h07_classify_tokens_first_match", with_ctes(V1_SQL, V8_SQL, body="""
, f AS (SELECT name, min(CASE category WHEN 'languages' THEN 1 WHEN 'frameworks' THEN 2 WHEN 'libraries' THEN 3 ELSE 4 END) AS ord
  FROM (SELECT * FROM dict UNION ALL SELECT 'frameworks', name FROM dict WHERE length(name) > 6) GROUP BY name),
t AS (SELECT doc_id, token, coalesce(ord, 5) AS ord FROM (SELECT doc_id, unnest(tokens) AS token FROM v1) LEFT JOIN f ON token = name)
SELECT v1.doc_id, coalesce(a, '') AS languages, coalesce(b, '') AS frameworks, coalesce(c, '') AS libraries, coalesce(d, '') AS tools, coalesce(e, '') AS oov FROM v1 LEFT JOIN (
SELECT doc_id, string_agg(token, ' ' ORDER BY token) FILTER (ord = 1) AS a, string_agg(token, ' ' ORDER BY token) FILTER (ord = 2) AS b,
  string_agg(token, ' ' ORDER BY token) FILTER (ord = 3) AS c, string_agg(token, ' ' ORDER BY token) FILTER (ord = 4) AS d,
  string_agg(token, ' ' ORDER BY token) FILTER (ord = 5) AS e FROM t GROUP BY doc_id) j ON v1.doc_id = j.doc_id""").replace("\n\n, f", ",\nf"))
def _(spark, folder, **options):
    base = v8_dictionary(spark, folder)
    both = base.unionByName(base.filter(F.length("name") > 6).select(F.lit("frameworks").alias("category"), "name"))
    rows = T.classify_tokens_first_match(v1_tokens(spark, folder).select("doc_id", "tokens"), "tokens", both, CATS, **options)
    return rows.select("doc_id", *[F.array_join(c, " ").alias(c) for c in (*CATS, "oov")])


@both_ways("h08_normalize_multivalue_category", with_ctes(V3_SQL, body="""
, m AS (SELECT * FROM (VALUES ('URGENT', 'b'), ('URGENT', 'a'), ('HIGH', 'b'), ('BUILDING', 'c'), ('MACHINERY', 'a'), ('MACHINERY', 'c'), ('LOW', 'd')) x(word, target))
SELECT v3.id, targets AS duty FROM v3 LEFT JOIN (SELECT id, string_agg(target, ', ' ORDER BY target) AS targets
  FROM (SELECT DISTINCT id, target FROM (SELECT id, unnest(string_split(duty, ', ')) AS word FROM v3) JOIN m USING (word)) GROUP BY id) t ON v3.id = t.id""").replace("\n\n, m", ",\nm"))
def _(spark, folder, **options):
    names = [("a, c", "MACHINERY"), ("b", "HIGH"), ("c", "BUILDING"), ("삭제", "MEDIUM"), ("b, a", "URGENT"), ("삭제, d", "LOW")]
    reverse = T.reverse_synonyms(spark.createDataFrame(names, "name string, synonym string"))
    rows = v3(spark, folder).select("id", F.replace("duty", F.lit(", "), F.lit(" ,  ")).alias("duty"))
    return T.normalize_multivalue(rows, "duty", reverse, **options)


@query("h09_unmapped_report", with_ctes(V1_SQL, V8_SQL, body="""
SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM v1) t WHERE NOT EXISTS (SELECT 1 FROM dict d WHERE d.name = t.token) GROUP BY token"""))
def _(spark, folder):
    return T.unmapped_report(v1_tokens(spark, folder), "tokens", v8_dictionary(spark, folder), "name")
