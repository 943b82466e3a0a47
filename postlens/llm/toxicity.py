"""Operator 8: toxicity by a weighted pattern grammar over clauses.

A word becomes a symbol: a set of classes, insult (a lexicon with weights, learned from labelled
texts), threat, target, object, negation, reported speech (fixed lists) and comma. Small
finite-state transducers read a clause's symbols and write them with marks: one marks what stands
in the scope of a negation, one what is reported, one what is near a target, one what threatens.
They are composed into one machine with one table; the marks that need what follows are written
by machines that read the clause backwards. The matched clauses' weights go into four channels:
plain insults, insults at a target, insults inside negation or reported speech, and threats at a
target. A logistic function of the channels' sums over the clauses gives the score.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.bloom import BloomFilter
from postlens.llm.common import ROW_BATCH_BYTES, batch_of, free_name, pieces, prepare, stored, texts
from postlens.session import stored_bytes

#: A lexicon word stands in so many different surroundings in toxic training texts, ...
LEAST_CONTEXTS = 3
#: ... its share among toxic texts exceeds that among others by this log-ratio ...
LEAST_WEIGHT = 2.5
#: ... and that is no chance: its log-likelihood ratio is at least this.
LEAST_EVIDENCE = 30.0
#: Bytes of a stored lexicon that every task is given; texts meet a larger one in a join.
LEXICON_BYTES = 4 << 20
#: Beginnings of words that many lexicon words share.
STEM_LENGTHS, LEAST_STEM_WORDS = (4, 5, 6), 3
#: Parts of the labelled texts, by digest, each of which is scored with a lexicon of the others when the logistic function is fitted.
FOLDS = 4
#: Rows of labelled channel sums that the logistic function is fitted on, at most.
FIT_ROWS = 50_000
WORD = re.compile(r"[^\W\d_]+")
#: Words and commas of a clause.
PART = re.compile(r"[^\W\d_]+|,")
CLAUSE = re.compile(r"[.!?;:\n]+")

# Word lists of the grammar, in four languages.
THREATS = frozenset("kill hurt destroy beat stab shoot strangle smash töten vernichten schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours you're he she him her they them their these those people du dich dir ihr euch sie er tu toi te vous ils elles lui tú usted ustedes ellos ellas él ella".split())
NEGATIONS = frozenset("not never no nobody isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say wrote writes quoted quote reported claimed called sagte sagt schrieb dit écrit disait dijo dice escribió".split())
OBJECTS = frozenset("dich dir euch te toi vous os le la les lo los las".split())

#: How far in words a mark reaches: a negation forward, a target both ways, a threat to the object after it and
#: from the object before it. A comma counts as two words.
NEGATION_REACH, TARGET_REACH, AFTER_REACH, BEFORE_REACH, COMMA = 3, 5, 2, 3, 2
CHANNELS = ("insult", "aimed", "softened", "threat")

INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, PAUSE, SOFT, NEAR, MEANT = (1 << k for k in range(10))
SYMBOLS = 1 << 10


@dataclass
class Transducer:
    """State 0 is the start. ``to`` and ``out`` hold the next state and the symbol written, by state and symbol read."""

    to: np.ndarray
    out: np.ndarray

    def run(self, symbols: list[int]) -> list[int]:
        state, written = 0, []
        for symbol in symbols:
            written.append(int(self.out[state, symbol]))
            state = int(self.to[state, symbol])
        return written

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: ``other`` reads what this one writes. Only pairs of states that are reached remain."""
        pairs, to, out = {(0, 0): 0}, [], []
        waiting = [(0, 0)]
        while waiting:
            a, b = waiting.pop(0)
            next_a, between = self.to[a], self.out[a]
            next_b = other.to[b, between]
            row = np.empty(SYMBOLS, np.int32)
            for pair in sorted(set(zip(next_a.tolist(), next_b.tolist()))):
                if pair not in pairs:
                    pairs[pair] = len(pairs)
                    waiting.append(pair)
                row[(next_a == pair[0]) & (next_b == pair[1])] = pairs[pair]
            to.append(row)
            out.append(other.out[b, between])
        return Transducer(np.array(to), np.array(out))


def scope(opens: int, reach: int, mark: int, own: bool = False, only: int = 0) -> Transducer:
    """Marks the symbols up to ``reach`` words after one of class ``opens``, itself too if ``own`` is set.

    States count the words that the scope still covers. With ``only``, just symbols of that class get the mark.
    """
    symbols = np.arange(SYMBOLS)
    left = np.arange(reach + 1)[:, None]
    cost = np.where(symbols & PAUSE, COMMA, 1)[None, :]
    opening = (symbols & opens != 0)[None, :]
    covered = (left >= cost) | (opening & own)
    if only:
        covered = covered & (symbols & only != 0)[None, :]
    to = np.where(opening, reach, np.maximum(left - cost, 0))
    return Transducer(to.astype(np.int32), np.where(covered, symbols | mark, symbols).astype(np.int32))


def reported() -> Transducer:
    """Marks what follows a verb of speech, to the end of the clause, the verb too."""
    symbols = np.arange(SYMBOLS)
    speech = (symbols & REPORT != 0)[None, :] | np.array([[False], [True]])
    return Transducer(speech.astype(np.int32), np.where(speech, symbols | SOFT, symbols).astype(np.int32))


#: Reads a clause forwards: negation, speech, targets before an insult, objects before a threat.
FORWARDS = (
    scope(NEGATION, NEGATION_REACH, SOFT, own=True).then(reported())
    .then(scope(TARGET, TARGET_REACH, NEAR, own=True)).then(scope(OBJECT, BEFORE_REACH, MEANT, only=THREAT))
)
#: Reads what the other one wrote, backwards: targets after an insult and, closely, after a threat.
BACKWARDS = scope(TARGET, TARGET_REACH, NEAR).then(scope(TARGET, AFTER_REACH, MEANT, only=THREAT))


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = max((self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), default=0.0)
        return found

    def hits(self, words: set[str]) -> bool:
        if not self.words.keys().isdisjoint(words) or not THREATS.isdisjoint(words):
            return True
        return any(not self.stems.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths)


_CLASSES: dict[str, int] = {",": PAUSE}
for _words, _mark in ((THREATS, THREAT), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
    for _word in _words:
        _CLASSES[_word] = _CLASSES.get(_word, 0) | _mark


def clause_channels(words: list[str], lexicon: Lexicon) -> np.ndarray:
    """What one clause, as words and commas, adds to the channels."""
    weights = [lexicon.weight(w) for w in words]
    symbols = [_CLASSES.get(w, 0) | (INSULT if x else 0) for w, x in zip(words, weights)]
    marked = BACKWARDS.run(FORWARDS.run(symbols)[::-1])[::-1]
    out = np.zeros(len(CHANNELS))
    for symbol, weight in zip(marked, weights):
        if symbol & INSULT:
            out[2 if symbol & SOFT else 0] += weight
            if symbol & NEAR and not symbol & SOFT:
                out[1] += weight
        if symbol & MEANT and not symbol & SOFT:
            out[3] += 1.0
    return out


def text_channels(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """Sums over the clauses; None for a text without any insult or threat."""
    low = text.lower()
    if not lexicon.hits(set(WORD.findall(low))):
        return None
    total = np.zeros(len(CHANNELS))
    for clause in CLAUSE.split(low):
        words = PART.findall(clause)
        if words and lexicon.hits(set(words)):
            total += clause_channels(words, lexicon)
    return total


def features(channels: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(channels), 1)), np.log1p(channels), channels > 0), axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method with a small ridge on all but the constant; never below zero but for it."""
    weights, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - keep @ weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep
        step = np.linalg.solve(curve, slope)
        weights = weights + np.clip(step, -2, 2)
        weights[1:] = weights[1:].clip(min=0)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def text_digest():
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """(digest, text, toxic) of each different text; toxic is 1 if most of its labels are.

    Copies are merged before the shuffle, so a text may be repeated in any number of rows.
    """
    rows = labelled.filter("toxic is not null").select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    merged = rows.withColumn("digest", text_digest()).groupBy("digest").agg(F.min("text").alias("text"), F.avg("toxic").alias("share"))
    return stored(merged.select("digest", "text", (F.col("share") > 0.5).cast("int").alias("toxic")), "toxic-labelled")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``distinct_texts`` of the documents that have a label; ``labels`` has (doc_id, toxic).

    The plan is the same at every size: a Bloom filter of the labelled ids is looked up in the
    scan, and only the texts that pass are shuffled to meet their labels.
    """
    prepare(docs)
    known = stored(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    own = BloomFilter.of(known, "doc_id").keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), "doc_id")
    return distinct_texts(own.hint("merge").join(known, "doc_id"))


@dataclass
class LexiconTable:
    """``entries``: (key, stem, weight), a word or, where ``stem`` is true, the beginning of words."""

    entries: DataFrame
    bytes: int

    def local(self) -> Lexicon | None:
        """For the tasks, if it is no larger than ``LEXICON_BYTES``."""
        if self.bytes > LEXICON_BYTES:
            return None
        rows = self.entries.collect()
        return Lexicon({r["key"]: r["weight"] for r in rows if not r["stem"]}, {r["key"]: r["weight"] for r in rows if r["stem"]})


def fold_of() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(FOLDS))


#: The sets of folds that a lexicon is learned from: all, and all but one of them.
VARIANTS = [list(range(FOLDS))] + [[k for k in range(FOLDS) if k != out] for out in range(FOLDS)]


def _by_variant(df: DataFrame, *letters: str, **sizes: list[int]) -> DataFrame:
    """A row for each variant, its number in ``variant``, with the sums of its folds' columns and sizes."""
    def one(number: int, folds: list[int]) -> Column:
        sums = [reduce(Column.__add__, [F.col(f"{letter}{k}") for k in folds]).alias(letter) for letter in letters]
        return F.struct(F.lit(number).alias("variant"), *sums, *[F.lit(sum(of[k] for k in folds)).alias(name) for name, of in sizes.items()])

    kept = [c for c in df.columns if not re.fullmatch(f"[{''.join(letters)}][0-9]+", c)]
    every = F.explode(F.array(*[one(k, folds) for k, folds in enumerate(VARIANTS)])).alias("by")
    return df.select(*kept, every).select(*kept, "by.*").filter(" + ".join(letters) + " > 0")


def _weight() -> Column:
    """The log-ratio of a word's shares of toxic and of other texts; columns t, n, toxic, other."""
    return F.log((F.col("t") + 0.5) / (F.col("toxic") + 1.0)) - F.log((F.col("n") + 0.5) / (F.col("other") + 1.0))


def _favoured() -> Column:
    """Whether t toxic and n other texts are enough for an entry."""
    t, n, toxic, other = F.col("t"), F.col("n"), F.col("toxic") + 1.0, F.col("other") + 1.0
    expected = (t + n) / (toxic + other)
    evidence = 2 * (t * F.log(t / (expected * toxic)) + F.when(n > 0, n * F.log(n / (expected * other))).otherwise(0.0))
    return (t >= LEAST_CONTEXTS) & (_weight() >= LEAST_WEIGHT) & (evidence >= LEAST_EVIDENCE)


def learn_lexicons(labelled: DataFrame) -> list[LexiconTable]:
    """From ``distinct_texts``: words and stems that toxic texts favour, for each of ``VARIANTS``.

    Counts cover all labelled texts, each different one once. What a word owes to near copies is
    taken off, too: all its places in toxic texts that share the most frequent two words before it
    or the most frequent two after it count as one. A stem speaks for words that aren't in the
    lexicon, and is judged by what such words of the training texts show.
    """
    folds = range(FOLDS)
    rows = labelled.select("toxic", fold_of().alias("fold"), F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+").alias("words"))
    own = [F.coalesce(F.sum(F.when(F.col("fold") == k, value)), F.lit(0)).alias(f"{letter}{k}") for letter, value in (("t", F.col("toxic")), ("n", 1 - F.col("toxic"))) for k in folds]
    counts = stored(rows.select("toxic", "fold", F.explode(F.array_distinct("words")).alias("word")).filter("word <> ''").groupBy("word").agg(*own), "toxic-words")
    size = rows.agg(*own).first()
    sizes = {"toxic": [size[f"t{k}"] for k in folds], "other": [size[f"n{k}"] for k in folds]}
    likely = stored(_by_variant(counts, "t", "n", **sizes).filter(_favoured()), "toxic-likely")

    at = lambda k: F.coalesce(F.get("words", k), F.lit(""))
    around = F.transform("words", lambda w, k: F.struct(w.alias("word"), F.concat_ws(" ", at(k - 2), at(k - 1)).alias("before"), F.concat_ws(" ", at(k + 1), at(k + 2)).alias("after")))
    places = rows.filter("toxic = 1").select("fold", F.explode(around).alias("p")).select("fold", "p.*")
    seen = [F.count_if(F.col("fold") == k).alias(f"c{k}") for k in folds]
    places = BloomFilter.of(likely, "word").keep(places, "word").groupBy("word", "before", "after").agg(*seen)
    places = stored(_by_variant(places, "c"), "toxic-places")

    def commonest(side: str) -> DataFrame:
        sums = places.groupBy("variant", "word", side).agg(F.sum("c").alias("c"))
        return sums.groupBy("variant", "word").agg(F.max(F.struct("c", side))[side].alias(f"top_{side}"))

    key = ["variant", "word"]
    others = places.join(commonest("before"), key).join(commonest("after"), key).filter("before <> top_before and after <> top_after")
    varied = others.groupBy(*key).agg((F.sum("c") + 1).alias("seen"))
    entries = stored(likely.join(varied, key).withColumn("t", F.least("t", "seen")).filter(_favoured()).select(*key, _weight().alias("weight")), "toxic-entries")

    def stems(least: int) -> Column:
        """The beginnings of a word with ``least`` more letters after them."""
        return F.explode(F.array_compact(F.array(*[F.when(F.length("word") >= k + least, F.substring("word", 1, k)) for k in STEM_LENGTHS]))).alias("stem")

    shared = stored(entries.select("variant", stems(1)).groupBy("variant", "stem").agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST_STEM_WORDS).drop("k"), "toxic-stems")
    like = BloomFilter.of(shared, "stem").keep(counts.select("*", stems(0)), "stem")
    rest = _by_variant(like, "t", "n").join(shared, ["variant", "stem"], "left_semi").join(entries, key, "left_anti")
    spark = labelled.sparkSession
    known = spark.createDataFrame([(k, *(sum(of[f] for f in folds) for of in sizes.values())) for k, folds in enumerate(VARIANTS)], "variant int, toxic long, other long")
    good = rest.groupBy("variant", "stem").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).join(F.broadcast(known), "variant").filter(_favoured())
    table = entries.select("variant", F.col("word").alias("key"), F.lit(False).alias("stem"), "weight")
    table = stored(table.unionByName(good.select("variant", F.col("stem").alias("key"), F.lit(True).alias("stem"), _weight().alias("weight"))), "toxic-lexicon")
    files = table.inputFiles()
    held = stored_bytes(spark, files[0].rsplit("/", 1)[0]) if files else 0
    return [LexiconTable(table.filter(F.col("variant") == k).drop("variant"), held) for k in range(len(VARIANTS))]


def with_hits(docs: DataFrame, table: LexiconTable) -> tuple[DataFrame, str]:
    """The rows with a map of the lexicon's weights for their own words, and the map's name; for a large lexicon."""
    row, hits = free_name(docs, "row"), free_name(docs, "hits")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "toxic-rows")
    words = rows.select(row, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+"))).alias("word"))
    keys = [F.struct(F.col("word").alias("key"), F.lit(False).alias("stem"))] + [
        F.when(F.length("word") >= n, F.struct(F.substring("word", 1, n).alias("key"), F.lit(True).alias("stem"))) for n in STEM_LENGTHS
    ]
    keyed = words.select(row, "word", F.explode(F.array_compact(F.array(*keys))).alias("k")).select(row, "word", "k.key", "k.stem")
    found = BloomFilter.of(table.entries, "key").keep(keyed, "key").join(table.entries, ["key", "stem"])
    best = found.groupBy(row, "word").agg(F.coalesce(F.max(F.when(~F.col("stem"), F.col("weight"))), F.max("weight")).alias("weight"))
    by_row = best.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias(hits))
    return rows.join(by_row, row, "left").drop(row), hits


class Model:
    def __init__(self, table: LexiconTable, weights: np.ndarray):
        self.table, self.weights, self.lexicon = table, weights, table.local()


def channel_table(docs: DataFrame, lexicon: Lexicon | None, table: LexiconTable, write, schema: str) -> DataFrame:
    """``write(part, sums)`` for parts of the rows and the channels' sums of their texts."""
    spark = prepare(docs, ROW_BATCH_BYTES)
    if lexicon is None:
        docs, name = with_hits(docs, table)
        place = docs.columns.index(name)
    else:
        shared = spark.sparkContext.broadcast(lexicon)  # at most LEXICON_BYTES as stored
    text, large, width = docs.columns.index("text"), lexicon is None, len(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(len(CHANNELS))
        for batch in batches:
            for part in pieces(batch, 1_000):
                own = texts(part.column(text))
                known = [Lexicon(dict(h or ()), {}) for h in part.column(place).to_pylist()] if large else [shared.value] * len(own)
                sums = [text_channels(t, k) if t else None for t, k in zip(own, known)]
                part = part.select([k for k in range(width) if not large or k != place])
                yield write(part, np.array([nothing if s is None else s for s in sums]).reshape(-1, len(CHANNELS)))

    return docs.mapInArrow(scan, schema)


def channel_sums(docs: DataFrame, lexicon: Lexicon | None, table: LexiconTable, *keep: str) -> DataFrame:
    """The kept columns and the channels' sums of each text."""
    source = docs.select(*[F.col(c).cast("long") for c in keep], F.col("text").cast("string"))
    schema = pa.schema([(c, pa.int64()) for c in keep] + [(c, pa.float64()) for c in CHANNELS])

    def write(part: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return batch_of({c: part.column(k) for k, c in enumerate(keep)} | {c: sums[:, k] for k, c in enumerate(CHANNELS)}, schema)

    return channel_table(source, lexicon, table, write, ", ".join([f"{c} long" for c in keep] + [f"{c} double" for c in CHANNELS]))


def learn(texts_with_labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From ``distinct_texts``: the lexicon from all of them, the logistic function from at most
    ``fit_rows``, the first ones by their digests.

    A lexicon fits the texts that it was learned from too well. So the function is fitted on sums
    that the texts of each fold get from a lexicon of the other folds.
    """
    prepare(texts_with_labels, ROW_BATCH_BYTES)
    lexicons = learn_lexicons(texts_with_labels)
    sample = stored(texts_with_labels.withColumn("rank", F.xxhash64("digest")).orderBy("rank").limit(fit_rows), "toxic-sample")
    sums = []
    for fold in range(FOLDS):
        others = lexicons[1 + fold]
        sums.append(channel_sums(sample.filter(fold_of() == fold), others.local(), others, "rank", "toxic"))
    rows = reduce(DataFrame.unionByName, sums).toPandas().sort_values("rank")
    table = lexicons[0]
    if not len(rows):
        return Model(table, np.concatenate(([-3.0], np.zeros(2 * len(CHANNELS)))))
    return Model(table, fit_logistic(features(rows[list(CHANNELS)].to_numpy()), rows["toxic"].to_numpy(float)))


def clean_documents(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows, all columns, whose score is below the limit. Null and empty texts have no pattern; repeated rows
    are judged each by itself; an empty table stays empty."""
    weights = model.weights

    def write(part: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(1 / (1 + np.exp(-(features(sums) @ weights))) < limit))

    return channel_table(docs, model.lexicon, model.table, write, docs.schema)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns (long), the channels and ``score`` for every row.

    Null and empty texts get the score of a text without any pattern. Each row is a document of
    its own; texts are read whole; other columns are not read.
    """
    sums = channel_sums(docs, model.lexicon, model.table, *keep)
    w = [float(x) for x in model.weights]
    linear = F.lit(w[0])
    for k, name in enumerate(CHANNELS):
        linear = linear + w[1 + k] * F.log1p(name) + w[1 + len(CHANNELS) + k] * (F.col(name) > 0).cast("double")
    return sums.withColumn("score", 1 / (1 + F.exp(-linear)))
