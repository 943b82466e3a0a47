"""The registered queries of this package: the thin contract over each operator's own interface."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import decontaminate, language, linededup, lm, packing, pii, quality, ranked, sharding, simhash, token_files, toxicity, trie
from postlens.llm.common import read, remainder, stored
from postlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_decontamination", """
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT item, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS win FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
place AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM doc, sizes WHERE len(w) >= size),
hit AS (SELECT p.r, p.s, p.size, win.item FROM place p JOIN win ON win.size = p.size AND array_to_string(p.w[p.s:p.s + p.size - 1], ' ') = win.win),
word AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS pos FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)""")
def op1(spark, folder):
    found = decontaminate.decontaminate(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_language_id")
def op2(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.learn(docs.filter(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_best_fit_packing")
def op3(spark, folder):
    return packing.pack_documents(read(spark, folder, "documents"))


@query("op4_lm_scoring")
def op4(spark, folder):
    docs = read(spark, folder, "documents")
    return lm.score(docs.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text"))


@query("op5_quality_rules")
def op5(spark, folder):
    return quality.judge(read(spark, folder, "documents"))


@query("op6_line_dedup")
def op6(spark, folder):
    cut = linededup.dedupe(read(spark, folder, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    words = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", words.cast("long").alias("n_removed"), F.concat_ws(",", spans).alias("removed"), F.md5("text").alias("text_md5"))


@query("op7_simhash_near_dedup")
def op7(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query("op9_token_binary")
def op9(spark, folder):
    path = scratch_path(spark, "token-blocks")
    token_files.write_token_blocks(read(spark, folder, "documents"), path)
    return token_files.read_token_documents(spark, path)


TOXIC_FROM = 0.3


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    known = read(spark, folder, "labels").filter(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")
    return toxicity.learn(toxicity.labelled_texts(read(spark, folder, "documents"), known))


@query("op8_toxicity")
def op8(spark, folder):
    docs = read(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, folder), "doc_id")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query("op10_pii")
def op10(spark, folder):
    return pii.digests(pii.personal_data(read(spark, folder, "documents")))


SHARDS = 40
ROW_BYTES = 16


@query("op11_sharding")
def op11(spark, folder):
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = read(spark, folder, "documents").select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.uniform_shards(rows, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


LONGEST_OPENING = 5


@query("op12_conversation_trie", """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT conv_id, conv_id - conv_id % 100 AS source, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 6 AS h FROM ids),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id AS source, count(*) AS n FROM turns GROUP BY 1),
rebuilt AS (SELECT p.conv_id, t.pos, t.mark, t.chars FROM plan p JOIN turns t ON t.conv_id = p.source WHERE t.pos <= p.h
    UNION ALL SELECT p.conv_id, t.pos - p.h + least(p.h, coalesce(n, 0)), t.mark, t.chars FROM plan p LEFT JOIN sizes USING (source) JOIN turns t ON t.conv_id = p.conv_id WHERE t.pos > p.h),
paths AS (SELECT conv_id, string_agg(mark, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS key, chars FROM rebuilt UNION ALL SELECT conv_id, '', 0 FROM ids),
nodes AS (SELECT key, length(key) // 32 AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY key),
above AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN above USING (key)),
up AS (SELECT left(key, 32 * i) AS key, n_children, (n_convs - 1) * chars AS saved FROM whole, unnest(range(0, depth + 1)) AS u(i)),
sums AS (SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM up GROUP BY key),
last AS (SELECT conv_id, max_by(key, length(key)) AS key FROM paths GROUP BY conv_id),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS listed FROM last GROUP BY key)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(listed, '')) AS ends_sha256
FROM whole w JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON w.depth > 0 AND p.key = left(w.key, length(w.key) - 32)""")
def op12(spark, folder):
    turns = stored(trie.ordered_turns(read(spark, folder, "conversations")), "trie-turns")
    conversations = turns.filter("pos = 1").select("conv_id")
    c = F.col("conv_id")
    opening = F.crc32(c.cast("string")) % (LONGEST_OPENING + 1)
    rebuilt = stored(trie.with_openings(turns, conversations, c - c % 100, opening, LONGEST_OPENING), "trie-rebuilt")
    found = trie.prefix_trie(rebuilt, conversations)
    nodes = found.nodes.join(trie.list_digests(found.ends), "node", "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


@query("op13_ranked_search", """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc WHERE len(w) > 0),
asked AS (SELECT i, term, count(*) AS repeats FROM (SELECT i, unnest(w) AS term FROM item) GROUP BY i, term),
posting AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM doc) SEMI JOIN asked USING (term) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM posting, total GROUP BY term, n_docs),
part AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS value FROM posting JOIN weighed USING (term), total),
scored AS (SELECT i, r, doc_id, sum(repeats * value)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY i, r, doc_id HAVING sum(repeats * value) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored) JOIN item USING (i) WHERE rank <= 20""")
def op13(spark, folder):
    return ranked.search(ranked.build_index(read(spark, folder, "documents")), read(spark, folder, "benchmark"))
