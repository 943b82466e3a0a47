"""L: labelled tokens."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import V2_LISTS_SQL, V2_SQL, V8_SQL, V9_SQL, table, v2_rows, v2_skill_lists, v8_dictionary, v8_tokens, v9, with_ctes
from postlens.functions import tokens as K
from postlens.operators import labels as L, tokens as T
from postlens.plans.labelled import labelled_tokens
from postlens.session import saved_copy

IDS = "MAP {'O': 0, 'B-LANGUAGES': 1, 'B-FRAMEWORKS': 2, 'B-LIBRARIES': 3, 'B-TOOLS': 4}"


def annotated(spark, folder):
    return T.annotate_tokens(v8_tokens(spark, folder), "tokens", v8_dictionary(spark, folder))


TAG_LISTS_SQL = """tl AS (SELECT v8.conv_id, v8.turn, v8.tokens, coalesce(tags, []) AS tags FROM v8 LEFT JOIN
  (SELECT conv_id, turn, list(tag ORDER BY pos) AS tags FROM tagged GROUP BY conv_id, turn) t ON v8.conv_id = t.conv_id AND v8.turn = t.turn)"""


@query("l01_l03_annotate_tokens", with_ctes(V8_SQL, TAG_LISTS_SQL, body="""
SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens, array_to_string(tags, ',') AS tags FROM tl"""))
def _(spark, folder):
    return annotated(spark, folder).select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", ",").alias("tags"))


@query("l03_flatten_token_tags", with_ctes(V8_SQL, body="SELECT conv_id, turn, array_to_string(tokens, ' ') AS spaced, array_to_string(tokens, ',') AS commas FROM v8"))
def _(spark, folder):
    from postlens.functions.lists import join_list

    return v8_tokens(spark, folder).select("conv_id", "turn", join_list("tokens", " ").alias("spaced"), join_list("tokens", ",").alias("commas"))


@query("l02_expand_multiword_tags", with_ctes(V2_SQL, V2_LISTS_SQL, body="""
SELECT id, array_to_string(skills, ' ') AS tokens, array_to_string(list_transform(flatten([CASE CAST(substr(s, 7) AS INTEGER) % 4
  WHEN 0 THEN ['B-LANGUAGES', 'I-LANGUAGES'] WHEN 1 THEN ['B-FRAMEWORKS', 'I-FRAMEWORKS'] ELSE ['O', 'O'] END FOR s IN skills]), lambda x: x), ',') AS tags FROM lists"""))
def _(spark, folder):
    names = v2_rows(spark, folder).select("skill", "category").distinct().select(
        F.col("skill").alias("name"), F.when(F.col("category") == "it_language", "languages").when(F.col("category") == "framework", "frameworks").alias("category"))
    rows = T.annotate_tokens(v2_skill_lists(spark, folder).select("id", "skills"), "skills", names)
    spread = rows.select("id", K.expand_multiword_tags("skills", "tags").alias("x"))
    return spread.select("id", F.array_join("x.token", " ").alias("tokens"), F.array_join("x.tag", ",").alias("tags"))


@query("l04_encode_labels", with_ctes(V8_SQL, TAG_LISTS_SQL, body=f"""
SELECT conv_id, turn, array_to_string([coalesce({IDS}[t], 0) FOR t IN tags], ',') AS ids FROM tl"""))
def _(spark, folder):
    ids = K.encode_labels("tags")
    return annotated(spark, folder).select("conv_id", "turn", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("l05_mask_subwords", with_ctes(V8_SQL, TAG_LISTS_SQL, body=f"""
SELECT conv_id, turn, array_to_string(flatten([CASE WHEN length(x[1]) > 3 THEN [coalesce({IDS}[x[2]], 0), -100] ELSE [coalesce({IDS}[x[2]], 0)] END FOR x IN [[tokens[i], tags[i]] FOR i IN range(1, len(tokens) + 1)]]), ',') AS labels FROM tl"""))
def _(spark, folder):
    pieces = F.flatten(F.transform("tokens", lambda t: F.when(
        F.length(t) > 3, F.array(F.substring(t, 1, 3), F.concat(F.lit("##"), F.substr(t, F.lit(4))))).otherwise(F.array(t))))
    rows = annotated(spark, folder).select("conv_id", "turn", pieces.alias("pieces"), K.encode_labels("tags").alias("ids"))
    return rows.select("conv_id", "turn", F.array_join(K.mask_subwords("pieces", "ids").cast("array<string>"), ",").alias("labels"))


@query("l06_replicate_label_to_pieces", """
SELECT p_partkey, array_to_string([p_type FOR x IN string_split(p_name || ' ##x', ' ')], ' ') AS labels FROM part""")
def _(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.replicate_label(F.concat("p_name", F.lit(" ##x")), "p_type").alias("labels"))


@query("l07_pad_truncate_labels", with_ctes(V8_SQL, TAG_LISTS_SQL, body=f"""
SELECT conv_id, turn, array_to_string(list_resize([coalesce({IDS}[t], 0) FOR t IN tags], 40, 0), ',') AS ids FROM tl"""))
def _(spark, folder):
    padded = K.pad_labels(K.encode_labels("tags"), 40)
    return annotated(spark, folder).select("conv_id", "turn", F.array_join(padded.cast("array<string>"), ",").alias("ids"))


@query("l08_split_train_val_test", """
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('200:' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents),
c AS (SELECT *, CAST(round_even(n * 0.8, 0) AS BIGINT) AS train FROM p)
SELECT doc_id, CASE WHEN pos <= train THEN 'train' WHEN pos <= train + CAST(round_even((n - train) * 0.5, 0) AS BIGINT) THEN 'val' ELSE 'test' END AS part FROM c""")
def _(spark, folder):
    return L.split_train_val_test(table(spark, folder, "documents").select("doc_id"), "doc_id")


COPIES_SQL = """x AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_type) AS have FROM part)"""


@query("l09_oversample_to_largest", with_ctes(COPIES_SQL, body="""
SELECT p_partkey, p_type, unnest(range(need // have + CASE WHEN pos < need % have THEN 1 ELSE 0 END + 1)) AS copy FROM (SELECT *, max(have) OVER () - have AS need FROM x)
UNION ALL SELECT p_partkey, 'new' AS p_type, 0 FROM part WHERE p_size > 45"""))
def _(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    new = table(spark, folder, "part").filter("p_size > 45").select("p_partkey", F.lit("new").alias("p_type"))
    return L.oversample_to_largest(part, "p_partkey", "p_type", new)


@query("l10_fill_label_quota", with_ctes(COPIES_SQL, body="""
, k AS (SELECT p_type, count(*) AS kept FROM part WHERE p_size > 30 AND p_type IN ('PROMO', 'ECONOMY', 'STANDARD') GROUP BY p_type),
q AS (SELECT x.*, greatest(quota - coalesce(kept, 0), 0) AS need FROM x JOIN (VALUES ('PROMO', 1000), ('ECONOMY', 300), ('STANDARD', 1), ('MEDIUM', 7)) v(t, quota) ON p_type = t LEFT JOIN k ON k.p_type = x.p_type)
SELECT p_partkey, p_type, 0::BIGINT AS copy FROM part WHERE p_size > 30 AND p_type IN ('PROMO', 'ECONOMY', 'STANDARD') UNION ALL
SELECT p_partkey, p_type, unnest(range(1, need // have + CASE WHEN pos < need % have THEN 1 ELSE 0 END + 1)) AS copy FROM q""").replace("\n\n, k", ",\nk"))
def _(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    out = L.fill_label_quota(part.filter("p_size > 30"), part, "p_partkey", "p_type", ["PROMO", "ECONOMY", "STANDARD"],
                             {"PROMO": 1000, "ECONOMY": 300, "STANDARD": 1, "MEDIUM": 7})
    return out.drop("p_size")


@query("l11_label_to_category", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'language' WHEN 'ECONOMY' THEN 'tool' END AS category FROM part WHERE p_type IN ('PROMO', 'ECONOMY')""")
def _(spark, folder):
    label = F.when(F.col("p_type") == "PROMO", "B-LANG").when(F.col("p_type") == "ECONOMY", "B-TOOL").otherwise("B-OTHER")
    return L.label_to_category(table(spark, folder, "part").select("p_partkey", label.alias("label")), "label").drop("label")


@query("l12_promote_dictionary_tools", with_ctes(V8_SQL, body="""
SELECT final_label, count(*) AS n FROM (SELECT CASE WHEN d.name IS NOT NULL AND length(t.token) <> 6 THEN 'B-TOOL' WHEN length(t.token) = 6 THEN 'B-LIB' ELSE 'O' END AS final_label
  FROM tok t LEFT JOIN (SELECT DISTINCT name FROM dict WHERE category = 'tools') d ON t.token = d.name) GROUP BY final_label"""))
def _(spark, folder):
    tools = v8_dictionary(spark, folder).filter("category = 'tools'")
    rows = v8_tokens(spark, folder).select(F.explode("tokens").alias("word")).select(
        F.upper("word").alias("word"), F.when(F.length("word") == 6, "B-LIB").otherwise("O").alias("label"))
    return T.promote_dictionary_tools(rows, tools, "word", "label").groupBy("final_label").agg(F.count("*").alias("n"))


ENTITY_SQL = """
gc AS (SELECT seq, count(*) FILTER (gold LIKE 'B-%' OR coalesce(prev, 'O') = 'O') OVER (PARTITION BY seq ORDER BY pos) AS chunk, pos, gold FROM (SELECT *, lag(gold) OVER (PARTITION BY seq ORDER BY pos) AS prev FROM v9) WHERE gold <> 'O'),
pc AS (SELECT seq, count(*) FILTER (predicted LIKE 'B-%' OR coalesce(prev, 'O') = 'O') OVER (PARTITION BY seq ORDER BY pos) AS chunk, pos, predicted FROM (SELECT *, lag(predicted) OVER (PARTITION BY seq ORDER BY pos) AS prev FROM v9) WHERE predicted <> 'O'),
ge AS (SELECT seq, min(pos) AS s, max(pos) AS e FROM gc GROUP BY seq, chunk), pe AS (SELECT seq, min(pos) AS s, max(pos) AS e FROM pc GROUP BY seq, chunk),
m AS (SELECT (SELECT count(*) FROM ge JOIN pe USING (seq, s, e)) AS tp, (SELECT count(*) FROM pe) AS pred, (SELECT count(*) FROM ge) AS support),
r AS (SELECT tp / pred AS precision, tp / support AS recall, support FROM m)"""


@query("l13_entity_report", with_ctes(V9_SQL, ENTITY_SQL, body="""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, support
FROM r, (SELECT unnest(['X', 'micro avg', 'macro avg', 'weighted avg']) AS label)"""))
def _(spark, folder):
    report = L.entity_report(v9(spark, folder))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("l14_masked_token_accuracy", """
SELECT round(avg(a), 6) AS accuracy, count(*) AS batches FROM (SELECT b, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS a
FROM (SELECT doc_id // 4 AS b, CASE WHEN doc_id % 3 = 0 THEN -100 ELSE quality END AS label, 1 - toxic AS predicted FROM labels) WHERE label <> -100 GROUP BY b)""")
def _(spark, folder):
    rows = table(spark, folder, "labels").select(
        F.expr("doc_id div 4").alias("batch"), F.when(F.col("doc_id") % 3 == 0, -100).otherwise(F.col("quality")).alias("label"), (1 - F.col("toxic")).alias("predicted"))
    return L.masked_token_accuracy(rows, "batch", "label", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query("e05_labelled_tokens", with_ctes(V8_SQL, body="""
, named AS (SELECT DISTINCT token, CASE WHEN tag = 'O' AND length(token) = 6 THEN 'B-LIBRARIES' ELSE tag END AS label FROM tagged),
rows AS (SELECT * FROM named WHERE label <> 'B-TOOLS' UNION SELECT name, 'B-TOOLS' FROM dict WHERE category = 'tools'),
sizes AS (SELECT label, count(*) AS c FROM rows GROUP BY label), largest AS (SELECT max(c) AS m, count(*) * max(c) AS total FROM sizes),
cut AS (SELECT total, CAST(round_even(total * 0.8, 0) AS BIGINT) AS train FROM largest)
SELECT 'label' AS kind, label AS value, m AS n FROM sizes, largest UNION ALL SELECT 'distinct', label, c FROM sizes
UNION ALL SELECT 'part', 'train', train FROM cut UNION ALL SELECT 'part', 'val', CAST(round_even((total - train) * 0.5, 0) AS BIGINT) FROM cut
UNION ALL SELECT 'part', 'test', total - train - CAST(round_even((total - train) * 0.5, 0) AS BIGINT) FROM cut""").replace("\n\n, named", ",\nnamed"))
def _(spark, folder):
    """Counts of the labelled tokens: per label with and without copies, and per part."""
    texts, names = v8_tokens(spark, folder), v8_dictionary(spark, folder)
    six = texts.select(F.explode("tokens").alias("token")).filter(F.length("token") == 6).distinct()
    tools = names.filter("category = 'tools'").select(F.col("name").alias("token"), F.lit("B-TOOLS").alias("label"))
    rows = saved_copy(labelled_tokens(texts, "tokens", names, six.withColumn("new_label", F.lit("B-LIBRARIES")), F.col("label") == "B-TOOLS", tools), "labelled")
    count = lambda kind, column, df: df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return count("label", "label", rows).unionByName(count("distinct", "label", rows.filter("copy = 0"))).unionByName(count("part", "part", rows))
