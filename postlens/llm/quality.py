"""Operator 5: quality rules by divergence from language references, in DataFrame functions only.

Each text gives two histograms: classes of characters, and common words of several languages.
The medians of both over all texts of a language are its reference. A text is kept if it lies
within a Jensen-Shannon distance of some language's references; a histogram of too short a text
is not judged.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import prepare, stored

# The most common words of each language, in order of frequency.
COMMON_WORDS = {
    "en": "the of and to in is that it",
    "de": "der die und den von das mit nicht",
    "fr": "le les et des est que dans pour",
    "es": "el los y en por se con una",
}
# Classes of characters as patterns; white space, beyond ASCII and the rest come by subtraction.
CLASSES = {"capital": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?'\"()-]", "sign": r"[#*$%&|<>@+=/\\\[\]{}~^_`]"}
#: Distances up to which a text is like a language.
CLASS_DISTANCE, WORD_DISTANCE = 0.18, 0.28
#: Characters and words from which the histograms are judged.
LEAST_CHARACTERS, LEAST_WORDS = 100, 40

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = [w for line in COMMON_WORDS.values() for w in line.split()]


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, 1 + by, F.greatest(F.size(a), F.lit(1)))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms.

    Every step is a column of its own, so that no array is made twice. Windows of five words
    are compared by a 64-bit hash; only texts in which one repeats are sorted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.array_remove(F.split("_text", _BLANK), "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumn("_common", F.filter("_words", lambda w: w.isin(_WORDS)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))

    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", F.zip_with("_h1", _shifted(F.col("_h1"), 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h4", F.zip_with("_h2", _shifted(F.col("_h2"), 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h5", F.zip_with("_h4", _shifted(F.col("_h1"), 4), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h5", F.slice("_h5", 1, F.greatest(F.size("_words") - 4, F.lit(0))))
    df = df.withColumn("_twice", F.size(F.array_distinct("_h5")) < F.size("_h5"))
    df = df.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(F.transform("_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_pairs", F.zip_with(_shifted(F.col("_sorted"), 1), "_sorted", lambda b, a: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter("_pairs", lambda p: p.isNotNull())))))
    df = df.withColumn("_steps", F.zip_with("_at", _shifted(F.col("_at"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate("_steps", F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))

    n_chars, wide = F.length("_text"), F.octet_length("_text") - F.length("_text")
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_{name}", F.regexp_count("_text", F.lit(pattern)))
    counted = [F.col(f"_{name}") for name in CLASSES] + [F.length("_text") - F.col("word_chars"), wide]
    rest = n_chars - counted[0] - counted[1] - counted[2] - counted[3] - counted[4] - counted[5]
    df = df.withColumn("_classes", F.array(*[c.cast("double") for c in counted], F.greatest(rest, F.lit(0)).cast("double")))
    df = df.withColumn("_known", F.array(*[(F.size("_common") - F.size(F.array_remove("_common", w))).cast("double") for w in _WORDS]))
    df = df.withColumn("_histogram", F.concat("_known", F.array((F.col("n_words") - F.size("_common")).cast("double"))))
    df = df.withColumn("_length", n_chars.cast("long"))
    return df.drop(
        "_text", "_words", "_lines", "_common", "_h1", "_h2", "_h4", "_h5", "_twice", "_sorted", "_pairs", "_at", "_steps", "_known", *[f"_{n}" for n in CLASSES],
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits, 0 to 1."""
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(0.0))


def references(counted: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Both histograms for each language: the median share of every bin over its texts.

    Every language has one, whatever their number; a few dozen numbers of each reach the driver.
    Medians (as exact as 10,000 buckets of ``approx_percentile``) over all texts long enough to
    be judged; unlike sums they don't bend towards the texts that are to be found.
    """
    n_classes, n_words = len(CLASSES) + 3, len(_WORDS) + 1
    middle = [F.percentile_approx(F.col("_p")[k], 0.5).alias(f"c{k}") for k in range(n_classes)]
    middle += [F.percentile_approx(F.col("_q")[k], 0.5).alias(f"w{k}") for k in range(n_words)]
    rows = (
        counted.filter("lang is not null and not base_failed").filter((F.col("_length") >= LEAST_CHARACTERS) & (F.col("n_words") >= LEAST_WORDS))
        .groupBy("lang").agg(*middle).orderBy("lang").collect()
    )
    out = []
    for r in rows:
        parts = [[r[f"c{k}"] for k in range(n_classes)], [r[f"w{k}"] for k in range(n_words)]]
        out.append(tuple([x / (sum(part) or 1.0) for x in part] for part in parts))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, class_distance, word_distance, kept) for every row.

    Needs doc_id, text and lang (which only groups the references). ``base_failed``: fewer than
    10 words, or more than a fifth of them in repeated windows of five. The distances are the
    nearest language's: the one for which the larger of both, each over its limit, is smallest.
    Null texts are empty and fail; with no language at all nothing diverges. Rows may repeat;
    other columns are not read.
    """
    prepare(docs)
    own = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = stored(base_counts(own).drop("text").withColumn("base_failed", failed), "quality-counts")
    df = counted.withColumn("_p", shares(F.col("_classes"))).withColumn("_q", shares(F.col("_histogram")))
    known = references(df)
    if known:
        # one constant for any number of languages
        lists = F.from_json(F.lit(json.dumps([{"c": c, "w": w} for c, w in known])), "array<struct<c:array<double>,w:array<double>>>")
        df = df.withColumn("_all", F.transform(lists, lambda r: F.struct(divergence(F.col("_p"), r["c"]).alias("c"), divergence(F.col("_q"), r["w"]).alias("w"))))
        df = df.withColumn("_near", F.array_min(F.transform("_all", lambda d: F.struct(F.greatest(d["c"] / CLASS_DISTANCE, d["w"] / WORD_DISTANCE).alias("far"), d["c"].alias("c"), d["w"].alias("w")))))
        df = df.withColumn("class_distance", F.col("_near.c")).withColumn("word_distance", F.col("_near.w"))
    else:
        df = df.withColumn("class_distance", F.lit(0.0)).withColumn("word_distance", F.lit(0.0))
    like = ((F.col("_length") < LEAST_CHARACTERS) | (F.col("class_distance") <= CLASS_DISTANCE)) & (
        (F.col("n_words") < LEAST_WORDS) | (F.col("word_distance") <= WORD_DISTANCE)
    )
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & like).alias("kept"), "class_distance", "word_distance",
    )
