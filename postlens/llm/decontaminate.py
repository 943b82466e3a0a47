"""Operator 1: benchmark decontamination by a positional inverted index, in DataFrame functions only.

Test items become windows of consecutive words. Document frequencies over the whole corpus tell
the rarest terms of every window; the index stores the postings (term, text, position) of those.
The lists of a window's two rarest terms, each moved back by the term's offset, are intersected,
and what is left is compared word by word with the text.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.common import free_name, prepare, stored

WINDOW_WORDS = 13
#: A text is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
#: Lists that are intersected per window.
RAREST = 2
# Fixed value: what parts words, after A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words in order; only A-Z change case. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows_of(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(window, words, items): distinct windows with the ids of the items that hold them.

    An item of fewer words than ``size``, but not none, is one window. A null id counts as ''.
    """
    df = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    df = df.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words"))
    return df.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window", F.md5(F.array_join("words", " ")))


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): occurrences of the wanted terms in all texts."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos): postings of the terms; texts are known by their digest, equal ones once."""
    own = docs.select(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return own.join(terms, "term", "left_semi").distinct()


def rarest_terms(windows: DataFrame, frequency: DataFrame, k: int = RAREST) -> DataFrame:
    """(window, rank, term, shift): up to k different terms of each window, the rarest first.

    Windows with a term that no text has are left out: they can't occur.
    """
    places = windows.select("window", F.size(F.array_distinct("words")).alias("n"), F.posexplode("words").alias("shift", "term"))
    first = places.groupBy("window", "n", "term").agg(F.min("shift").alias("shift")).join(frequency, "term")
    order = Window.partitionBy("window")
    ranked = first.withColumn("found", F.count("*").over(order)).withColumn("rank", F.row_number().over(order.orderBy("df", "term")))
    return ranked.filter((F.col("found") == F.col("n")) & (F.col("rank") <= k)).select("window", "rank", "term", "shift")


def intersect(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(key, window, start): places where all of a window's rarest terms stand at their offsets."""
    wanted = rarest.groupBy("window").agg(F.max("rank").alias("lists"))
    places = index.join(rarest, "term").select("key", "window", (F.col("pos") - F.col("shift")).alias("start"), "rank").filter("start >= 0")
    met = places.groupBy("key", "window", "start").agg(F.count("*").alias("met"))
    return met.join(wanted, "window").filter("met = lists").select("key", "window", "start")


def proximity(index: DataFrame, rarest: DataFrame, slack: int) -> DataFrame:
    """(key, window): texts in which a window's two rarest terms stand within ``slack`` words of
    their distance in the window. Blocks of positions keep the join an equi-join."""
    width = 2 * slack + 1
    places = index.join(rarest, "term").select("key", "window", (F.col("pos") - F.col("shift")).alias("start"), "rank")
    one = places.filter("rank = 1").withColumn("block", F.floor(F.col("start") / width))
    two = places.filter("rank = 2").select("key", "window", F.col("start").alias("other"), F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("block"))
    near = one.join(two, ["key", "window", "block"]).filter(F.abs(F.col("start") - F.col("other")) <= slack)
    alone = places.join(rarest.groupBy("window").agg(F.max("rank").alias("lists")).filter("lists = 1"), "window", "left_semi")
    return near.select("key", "window").union(alone.select("key", "window")).distinct()


def _covered(spans: Column) -> Column:
    """Words inside the union of [start, end) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, span: Column) -> Column:
        more = F.greatest(span["end"] - F.greatest(span["start"], state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], span["end"]).alias("end"), (state["n"] + more).cast("long").alias("n"))

    return F.aggregate(F.sort_array(spans), start, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Every row of the documents with n_words, n_hit, items, contaminated.

    A word inside any occurrence of a window is hit; ``items`` are the sorted ids of the items
    with such windows; contaminated means n_hit > 0 and ``HIT_SHARE`` * n_hit >= n_words. All
    columns of the documents stay (columns of the four names are replaced). Null texts have no
    words. Repeated rows stay; an empty benchmark hits nothing.

    The texts are read once for frequencies, once for postings and once to be compared; the
    join on the digest is skewed only by equal texts, on the side that Spark can split.
    """
    prepare(docs)
    windows = stored(windows_of(items, size), "test-windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    rarest = stored(rarest_terms(windows, document_frequency(docs, stored(terms, "test-terms"))), "test-rarest")
    index = stored(build_index(docs, rarest.select("term").distinct()), "test-index")
    found = intersect(index, rarest).join(windows, "window")
    names = {"n_words", "n_hit", "items", "contaminated"}
    own = docs.drop(*names)
    key, hits, words, true, spans = (free_name(own, name) for name in ("key", "found", "words", "true", "spans"))
    by_text = found.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "words", "items")).alias(hits))

    own = own.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    df = own.join(by_text, key, "left").withColumn(words, words_of(F.col("text")))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn(true, F.filter(hits, lambda f: F.slice(words, f["start"] + 1, F.size(f["words"])) == f["words"]))
    df = df.withColumn(spans, F.transform(true, lambda f: F.struct(f["start"].alias("start"), (f["start"] + F.size(f["words"])).alias("end"))))
    df = df.withColumn("n_hit", F.coalesce(_covered(F.col(spans)), F.lit(0)).cast("long"))
    df = df.withColumn("items", F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(true, lambda f: f["items"])))), F.array().cast("array<string>")))
    df = df.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
    return df.drop(key, hits, words, true, spans)
