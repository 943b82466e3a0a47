"""Token tables: dictionary tokenising, synonyms, classification, annotation.

A posting is one row with an array of tokens. With a dictionary of bounded size each row is
worked in place, tokenising and classifying by Arrow batch. A larger dictionary is joined on exploded tokens. A Bloom filter of its keys is
looked up first, where the tokens lie, so only tokens that hit it, and few others, are shuffled;
hot tokens meet a broadcast table and aren't shuffled at all. Hits return to their row as a small
map. The rows are then written to the shared folder first, with a number of their own, as both
sides of that join read them. Both ways give the same rows; a ``Dictionary`` made beforehand
serves several calls.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlens import constants as K
from postlens.functions.batches import category_cells, whole_terms
from postlens.functions.bloom import BloomFilter
from postlens.functions.lookup import MAX_ENTRIES, Dictionary, bounded_lookup, entries_of
from postlens.functions.tokens import normalize_token, words
from postlens.operators.joins import join_hot
from postlens.session import bounded_batches, saved_copy

_STRINGS = "array<string>"
_ROW = "_row"


def _numbered_copy(df: DataFrame, label: str) -> DataFrame:
    """The stored rows with a number, unique whatever columns or repeats the rows have."""
    return saved_copy(df.withColumn(_ROW, F.monotonically_increasing_id()), label)


def hits_of(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """The tokens (any columns and ``key``) that ``table`` has (unique ``key``), with their ``value``.

    Only what passes the Bloom filter goes on.
    """
    return _meet(BloomFilter.of(table, "key").keep(tokens, "key"), table)


def hits_in(rows: DataFrame, keys: str, table: DataFrame) -> DataFrame:
    """(_row, the fields of the elements, value) of the elements of an array column, structs with a field ``key``, that ``table`` has.

    The Bloom filter is looked up in the row, so only what passes it becomes a row.
    """
    placed = BloomFilter.of(table, "key").places(rows, F.transform(keys, lambda e: e["key"]), "_likely")
    return _meet(placed.select(_ROW, F.inline(F.transform("_likely", lambda i: F.get(keys, i)))), table)


def _meet(likely: DataFrame, table: DataFrame) -> DataFrame:
    """Rows joined with the table; they are written down and counted by key, which tells the hot ones."""
    likely = saved_copy(likely, "hits")
    counts = likely.groupBy("key").agg(F.count("*").alias("_n"))
    known = saved_copy(table.join(counts, "key"), "hit-keys")
    return join_hot(likely, known, "key", "_n").filter(F.col("value").isNotNull())


def attach_matches(df: DataFrame, keys: str, table: DataFrame, out: str = "_found") -> DataFrame:
    """Add a map key -> value of the row's distinct keys that ``table`` has (unique ``key`` and a ``value``).

    ``df`` is numbered and stored. Rows without a hit get an empty map.
    """
    tokens = df.select(_ROW, F.transform(F.array_distinct(keys), lambda t: F.struct(t.alias("key"))).alias("_tokens"))
    hits = hits_in(tokens, "_tokens", table).groupBy(_ROW).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(out))
    kind = f"map<string,{table.schema['value'].dataType.simpleString()}>"
    return df.join(hits, _ROW, "left").withColumn(out, F.coalesce(out, F.create_map().cast(kind)))


def _with_lookup(df: DataFrame, keys: Column, dictionary: "DataFrame | Dictionary", max_entries: int):
    """The frame and a function key -> value: in place for a bounded dictionary, else by a join."""
    ready = Dictionary.of(dictionary, max_entries)
    if ready.lookup:
        return df, ready.lookup.find
    joined = attach_matches(_numbered_copy(df.withColumn("_keys", keys), "tokens"), "_keys", ready.table)
    return joined.drop("_keys", _ROW), lambda key: F.try_element_at("_found", key)


def replace_tokens(
    df: DataFrame, tokens: str, replacements: "DataFrame | Dictionary", max_entries: int = MAX_ENTRIES
) -> DataFrame:
    """H4: each token to its canonical form by its lower case, unknown kept, order and repeats kept.

    ``replacements`` has lower-case ``key`` and ``value``; of equal keys the greatest value counts.
    """
    rows, find = _with_lookup(df, F.transform(tokens, F.lower), replacements, max_entries)
    return rows.withColumn(tokens, F.transform(tokens, lambda t: F.coalesce(find(F.lower(t)), t))).select(*df.columns)


class Phrases:
    """Dictionary terms of several words, made ready once: their lookup or table, greatest length."""

    def __init__(self, terms: DataFrame, max_entries: int = MAX_ENTRIES):
        rows = terms.select(F.lower(F.trim("term")).alias("key")).withColumn("value", F.size(F.split("key", " "))).filter("value > 1")
        self.longest = rows.agg(F.max("value")).first()[0] or 0
        self.found = Dictionary(rows, max_entries)
        opening = rows.select(F.substring_index("key", " ", 1).alias("key"), "value")
        self.opening = None if self.found.lookup else BloomFilter.of(opening.select("key").distinct(), "key")


def dictionary_tokenize(
    df: DataFrame, text: str, terms: "DataFrame | Phrases", stop_words: Sequence[str] = (),
    pattern: str = K.WORD_RUN, out: str = "tokens", max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """H3: text to tokens; dictionary terms of several words stay whole, stop words go.

    At each place the longest term wins, then the scan goes on behind it. ``terms`` has a
    column ``term``; terms may have any number of words.
    """
    ready = terms if isinstance(terms, Phrases) else Phrases(terms, max_entries)
    rows = df.withColumn("_words", words(text, pattern))
    w = F.col("_words")

    def go_on(rows, tokens):
        kept = tokens if not stop_words else F.filter(tokens, lambda t: ~t.isin(list(stop_words)))
        return rows.withColumn(out, kept).drop("_words", "_hits", "_cut")

    if ready.longest < 2:
        return go_on(rows, w)
    if ready.found.lookup:
        bounded_batches(df.sparkSession)
        return go_on(rows.withColumn("_words", whole_terms("_words", ready.found.lookup.entries)), w)
    rows = _numbered_copy(rows, "words")
    # Only places whose word opens a term go on, with the words that a term may take; of these, the groups that may be one.
    opened = ready.opening.places(rows.select(_ROW, "_words"), w, "_open").withColumn("_open", F.filter("_open", lambda i: i < F.size(w) - 1))
    group = lambda i, n: F.struct((i + 1).alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("key"))
    groups = F.flatten(F.transform("_open", lambda i: F.transform(
        F.sequence(F.lit(2), F.least(F.lit(ready.longest), F.size(w) - i)), lambda n: group(i, n))))
    hits = (
        hits_in(opened.select(_ROW, groups.alias("_groups")), "_groups", ready.found.table)
        .groupBy(_ROW, "at").agg(F.max("value").alias("n"))
        .groupBy(_ROW).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_hits"))
    )
    rows = rows.join(hits, _ROW, "left").drop(_ROW)

    # Fold the few hits of a row into the cut list: accepted hits with the place before them.
    empty = F.array().cast("array<struct<from:int,at:int,n:int>>")
    begin = F.struct(F.lit(1).alias("next"), empty.alias("cuts"))

    def accept(state, hit):
        cut = F.struct(state["next"].alias("from"), hit["at"].alias("at"), hit["n"].alias("n"))
        return F.when(
            hit["at"] >= state["next"],
            F.struct((hit["at"] + hit["n"]).alias("next"), F.array_append(state["cuts"], cut).alias("cuts")),
        ).otherwise(state)

    s = F.col("_cut")

    def span(first, last):
        return F.when(
            last >= first, F.transform(F.sequence(first, last), lambda i: F.get(w, i - 1))
        ).otherwise(F.array().cast(_STRINGS))

    pieces = F.flatten(
        F.transform(
            s["cuts"],
            lambda c: F.array_append(
                span(c["from"], c["at"] - 1), F.array_join(span(c["at"], c["at"] + c["n"] - 1), " ")
            ),
        )
    )
    merged = F.when(s.isNull() | (F.size(s["cuts"]) == 0), w).otherwise(F.concat(pieces, span(s["next"], F.size(w))))
    return go_on(rows.withColumn("_cut", F.aggregate("_hits", begin, accept)), merged)


def category_entries(dictionary: DataFrame, categories: Sequence[str] = K.CATEGORIES) -> DataFrame:
    """H6's lookup rows: key to its (category, name) pairs."""
    return dictionary.filter(F.col("category").isin(list(categories))).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("category", "name"))).alias("value")
    )


def classify_tokens_multi(
    df: DataFrame, tokens: str, dictionary: "DataFrame | Dictionary",
    categories: Sequence[str] = K.CATEGORIES, prefix: str = "", max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """H6: per category the sorted distinct canonical names found, joined; '' when none.

    ``dictionary`` has category, key, name (or is made from ``category_entries``). Tokens are normalised before the lookup; give
    ``normalized_dictionary(...)`` to normalise the keys too, so that names of several words match.
    """
    entries = dictionary if isinstance(dictionary, Dictionary) else category_entries(dictionary, categories)
    entries = Dictionary.of(entries, max_entries)
    keys = F.transform(tokens, normalize_token)
    if entries.lookup:
        bounded_batches(df.sparkSession)
        rows = df.withColumn("_cells", category_cells(keys, entries.lookup.entries, categories))
        return rows.select(*df.columns, *[F.col("_cells")[c].alias(prefix + c) for c in categories])
    rows, find = _with_lookup(df.withColumn("_norm", F.array_distinct(keys)), F.col("_norm"), entries, max_entries)
    none = F.array().cast("array<struct<category:string,name:string>>")
    rows = rows.withColumn("_hit", F.flatten(F.transform("_norm", lambda t: F.coalesce(find(t), none))))

    def cell(c):
        names = F.transform(F.filter("_hit", lambda h: h["category"] == c), lambda h: h["name"])
        return F.coalesce(F.array_join(F.sort_array(F.array_distinct(names)), ", "), F.lit(""))

    return rows.withColumns({prefix + c: cell(c) for c in categories}).select(*df.columns, *[prefix + c for c in categories])


def classify_tokens_first_match(
    df: DataFrame, tokens: str, dictionary: DataFrame,
    categories: Sequence[str] = K.CATEGORY_ORDER, rest: str = "oov", max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """H7: each token to the first category that lists it, else ``rest``; sorted, repeats kept.

    ``dictionary`` has category and name.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")).cast("int")
    first = (
        dictionary.withColumn("ord", rank).filter("ord > 0")
        .groupBy(F.col("name").alias("key")).agg(F.min("ord").alias("value"))
    )
    rows, find = _with_lookup(df, F.col(tokens), first, max_entries)
    placed = F.transform(F.sort_array(tokens), lambda t: F.struct(t.alias("token"), F.coalesce(find(t), F.lit(0)).alias("ord")))
    rows = rows.withColumn("_placed", placed)

    def of(position):
        names = F.transform(F.filter("_placed", lambda p: p["ord"] == position), lambda p: p["token"])
        return F.coalesce(names, F.array().cast(_STRINGS))

    lists = {c: of(i + 1) for i, c in enumerate(categories)} | {rest: of(0)}
    return rows.withColumns(lists).select(*df.columns, *lists)


def token_counts(df: DataFrame, tokens: str, out: str = "token") -> DataFrame:
    """Distinct tokens with their number, counted before the shuffle."""
    return df.select(F.explode(tokens).alias(out)).groupBy(out).agg(F.count("*").alias("count"))


def unmapped_report(df: DataFrame, tokens: str, dictionary: DataFrame, key: str = "key") -> DataFrame:
    """H9: tokens no dictionary entry covers, with counts."""
    return token_counts(df, tokens).join(dictionary.select(F.col(key).alias("token")), "token", "left_anti")


def normalize_multivalue(
    df: DataFrame, column: str, reverse: DataFrame, marker: str = K.DELETE_MARKER,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """H8: comma list to the sorted distinct canonical values; none left gives null.

    ``reverse`` has ``word`` and ``target``; a target may list several values by ', ', and
    the marker value is dropped. Of equal words the greatest target counts.
    """
    last = entries_of(reverse.select(F.col("word").alias("key"), F.col("target").alias("value")))
    entries = last.select("key", F.split("value", ", ").alias("value"))
    parts = F.transform(F.split(column, r"\s*,\s*"), lambda t: F.trim(t))
    rows, find = _with_lookup(df, parts, entries, max_entries)
    targets = F.flatten(F.transform(parts, lambda t: F.coalesce(find(t), F.array().cast(_STRINGS))))
    kept = F.sort_array(F.array_distinct(F.filter(targets, lambda t: t != marker)))
    return rows.withColumn(column, F.nullif(F.array_join(kept, ", "), F.lit(""))).select(*df.columns)


def reverse_synonyms(elements: DataFrame) -> DataFrame:
    """Word to canonical name from (name, comma list); of equal words the greatest name stays."""
    rows = elements.select(F.explode(F.split("synonym", ",")).alias("word"), F.col("name").alias("target"))
    return rows.groupBy("word").agg(F.max("target").alias("target"))


def annotate_tokens(
    df: DataFrame, tokens: str, dictionary: DataFrame,
    order: Sequence[str] = ("languages", "frameworks", "libraries", "tools"), out: str = "tags",
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """L1: token to B-<CATEGORY> (the later category in ``order`` wins), else O.

    ``dictionary`` has category and name; a row without tokens keeps an empty list.
    """
    names = F.array(*[F.lit(c) for c in order])
    last = (
        dictionary.withColumn("value", F.array_position(names, F.col("category")).cast("int")).filter("value > 0")
        .groupBy(F.col("name").alias("key")).agg(F.max("value").alias("value"))
    )
    labels = F.array(*[F.lit("B-" + c.upper()) for c in order])
    rows, find = _with_lookup(df, F.col(tokens), last, max_entries)
    tag = lambda t: F.coalesce(F.get(labels, find(t) - 1), F.lit(K.OUTSIDE))
    return rows.withColumn(out, F.transform(tokens, tag)).select(*df.columns, out)


def promote_dictionary_tools(
    df: DataFrame, tools: DataFrame, word: str, label: str, tool_label: str = "B-TOOL", out: str = "final_label"
) -> DataFrame:
    """A predicted O whose lower-case word is a tool name becomes the tool label."""
    named = tools.select(F.col("name").alias("_name")).distinct().withColumn("_tool", F.lit(True))
    hit = (F.col(label) == K.OUTSIDE) & F.coalesce(F.col("_tool"), F.lit(False))
    return (
        df.join(named, F.lower(F.col(word)) == F.col("_name"), "left")
        .withColumn(out, F.when(hit, F.lit(tool_label)).otherwise(F.col(label)))
        .drop("_name", "_tool")
    )
