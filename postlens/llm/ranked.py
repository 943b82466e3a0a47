"""Operator 13: ranked lexical search over hashed max-sketches.

A document's impacts are folded into a sketch: every term is hashed to one of ``COORDINATES``, and a
coordinate keeps the greatest number of occurrences of the terms on it. In a document of a given
length the impact of a term grows with its occurrences, so a coordinate's maximum gives no less
than the impact of any of its terms, whatever the corpus's statistics are. A batch of items is
looked up in a batch of sketches by one matrix product, which bounds all their scores from above.

The documents with an item's highest bounds are scored exactly first; the k-th best of these
scores is the threshold, and then every document whose bound reaches it is scored exactly. No
other document can be among the k best, so the ranking is that of a full evaluation.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.common import batch_of, pieces, prepare, stored, text_bytes

#: Coordinates of a sketch.
COORDINATES = 1 << 16
#: Occurrences up to which a coordinate tells them apart; from there on a bound takes the greatest impact there is.
MOST = 255
TOP = 20
#: Documents whose exact scores give an item's threshold: those with its highest bounds.
FIRST = 64
#: Items that are looked up together, and bytes of their texts, about.
ITEMS, ITEM_BYTES = 256, 1 << 16
#: Terms that a task counts before it hands the counts on.
COUNTED = 200_000
# Fixed values of the score: scale of an impact, weight of the length, and of a length's share in it.
SCALE, SLOPE, LENGTH = 1_000_000_000, 12, 25


def _folded() -> bytes:
    """Each byte's replacement: a-z for A-Z, a space for other ASCII but digits and letters."""
    table = bytearray(range(256))
    for c in range(0x80):
        if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A):
            table[c] = c + 0x20 if 0x41 <= c <= 0x5A else 0x20
    return bytes(table)


_FOLDED = _folded()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_norm(n: int, documents: int, all_terms: int) -> int:
    return 100 - LENGTH + LENGTH * n * documents // all_terms


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """64-bit integers; 0 for a term that doesn't occur."""
    tf = tf.astype(np.int64)
    return SCALE * tf // np.maximum(1000 * tf + SLOPE * m, 1)


INDEX_SCHEMA = "row long, doc_id long, text string, n long, at binary, most binary, term binary, df long"
_INDEX = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("at", pa.binary()), ("most", pa.binary()),
    ("term", pa.binary()), ("df", pa.int64()),
])


@dataclass
class Index:
    """``sketches``: (row, doc_id, text, n, at, most) of each document with a term, ``at`` the sketch's
    coordinates in use as 16-bit numbers and ``most`` their maxima; ``lexicon``: (term, df)."""

    sketches: DataFrame
    lexicon: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Sketches of all documents with a term, and the lexicon, in one scan.

    Only doc_id and text are read. Null texts have no terms; repeated rows are documents each.
    Nothing in the index depends on a query or on the corpus's statistics, so documents can be
    added by adding rows.
    """
    prepare(docs)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def counts() -> pa.RecordBatch:
            empty = {f.name: pa.nulls(len(known), f.type) for f in _INDEX}
            return batch_of(empty | {"term": list(known), "df": list(known.values())}, _INDEX)

        for batch in batches:
            for part in pieces(batch, 500):
                out = {f.name: [] for f in _INDEX}
                for row, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2))):
                    found = terms_of(text)
                    if not found:
                        continue
                    tf = Counter(found)
                    for term in tf:
                        known[term] = known.get(term, 0) + 1
                    hashed = np.fromiter(map(zlib.crc32, tf), np.int64, len(tf)) % COORDINATES
                    often = np.minimum(np.fromiter(tf.values(), np.int64, len(tf)), MOST)
                    order = np.lexsort((often, hashed))
                    last = np.flatnonzero(np.append(hashed[order][1:] != hashed[order][:-1], True))
                    sketch = hashed[order][last].astype("<u2").tobytes(), often[order][last].astype(np.uint8).tobytes()
                    for name, value in zip(_INDEX.names, (row, doc_id, text.decode(), len(found), *sketch, None, None)):
                        out[name].append(value)
                yield batch_of(out, _INDEX)
                if len(known) > COUNTED:
                    yield counts()
                    known.clear()
        yield counts()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index = stored(rows.mapInArrow(sketched, INDEX_SCHEMA), "search-index")
    sketches = index.filter("row is not null").drop("term", "df")
    lexicon = stored(index.filter("row is null").groupBy("term").agg(F.sum("df").alias("df")), "search-lexicon")
    documents, terms = sketches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(sketches, lexicon, documents, terms)


@dataclass
class Block:
    """Items looked up together: term weights times repeats, by term and by coordinate."""

    numbers: list[int]
    places: dict[bytes, int]
    by_term: np.ndarray
    coordinates: np.ndarray
    by_coordinate: np.ndarray


def make_block(index: Index, items: list[tuple[int, bytes]]) -> Block:
    """The weights of the terms that the corpus has; the lexicon is read for the items' terms alone."""
    wanted = {number: Counter(terms_of(text)) for number, text in items}
    asked = sorted(set().union(*wanted.values()))
    spark = index.lexicon.sparkSession
    found = index.lexicon.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in asked], "term binary")), "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in found.collect()} if asked else {}
    places = {t: k for k, t in enumerate(sorted(df))}
    hashed = np.array([zlib.crc32(t) % COORDINATES for t in places], np.int64)
    coordinates, column = np.unique(hashed, return_inverse=True)
    numbers = sorted(wanted)
    by_term, by_coordinate = np.zeros((len(places), len(numbers)), np.int64), np.zeros((len(coordinates), len(numbers)))
    for k, number in enumerate(numbers):
        for term, repeats in wanted[number].items():
            if term in places:
                value = repeats * weight(index.documents, df[term])
                by_term[places[term], k] = value
                by_coordinate[column[places[term]], k] += value
    return Block(numbers, places, by_term, coordinates, by_coordinate)


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in a row, and how many each value has."""
    wide = column.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2], np.uint8)[ends[0] : ends[-1]] if wide.buffers()[2] else np.empty(0, np.uint8)
    return raw.view(dtype), np.diff(ends) // np.dtype(dtype).itemsize


class Bounds:
    """Upper bounds of the scores of a block's items for a batch of sketches."""

    def __init__(self, block: Block, documents: int, terms: int):
        self.block, self.documents, self.terms = block, documents, terms
        self.column = np.full(COORDINATES, -1, np.int32)
        self.column[block.coordinates] = np.arange(len(block.coordinates))
        self.rows = max(16, min(512, (1 << 22) // max(1, len(block.coordinates))))

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        """``part``: (row, n, at, most); one line a document, one column an item. Whole numbers below 2**53."""
        at, size = _flat(part.column(2), "<u2")
        most, _ = _flat(part.column(3), "u1")
        column = self.column[at]
        some = column >= 0
        doc = np.repeat(np.arange(part.num_rows), size)[some]
        m = np.array([length_norm(n, self.documents, self.terms) for n in part.column(1).to_pylist()], np.int64)
        tf = most[some]
        high = np.where(tf == MOST, SCALE // 1000, impacts(tf, m[doc]))
        table = np.zeros((part.num_rows, len(self.block.coordinates)))
        table[doc, column[some]] = high
        return table @ self.block.by_coordinate


def highest_bounds(index: Index, block: Block, first: int) -> DataFrame:
    """(item, row, bound): the ``first`` documents of each item with the highest bounds above 0."""
    schema = pa.schema([("item", pa.int64()), ("row", pa.int64()), ("bound", pa.float64())])
    documents, terms = index.documents, index.terms

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(block, documents, terms)
        width = len(block.numbers)
        held, rows = np.zeros((0, width)), np.zeros((0, width), np.int64)
        for batch in batches:
            for part in pieces(batch, bounds.rows):
                held = np.concatenate((held, bounds(part)))
                own = np.asarray(part.column(0))
                rows = np.concatenate((rows, np.repeat(own[:, None], width, axis=1)))
                if len(held) > first:
                    keep = np.argpartition(-held, first - 1, axis=0)[:first]
                    held, rows = np.take_along_axis(held, keep, 0), np.take_along_axis(rows, keep, 0)
        line, k = np.nonzero(held > 0)
        yield batch_of({"item": np.array(block.numbers, np.int64)[k], "row": rows[line, k], "bound": held[line, k]}, schema)

    found = stored(index.sketches.select("row", "n", "at", "most").mapInArrow(best, "item long, row long, bound double"), "search-bounds")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first).drop("place")


def reaching(index: Index, block: Block, thresholds: dict[int, int]) -> DataFrame:
    """(item, row): all documents whose bound reaches the item's threshold."""
    schema = pa.schema([("item", pa.int64()), ("row", pa.int64())])
    documents, terms = index.documents, index.terms
    least = np.array([max(thresholds.get(number, 0), 1) for number in block.numbers], float)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(block, documents, terms)
        for batch in batches:
            for part in pieces(batch, bounds.rows):
                line, k = np.nonzero(bounds(part) >= least)
                yield batch_of({"item": np.array(block.numbers, np.int64)[k], "row": np.asarray(part.column(0))[line]}, schema)

    return index.sketches.select("row", "n", "at", "most").mapInArrow(enough, "item long, row long")


def exact_scores(index: Index, block: Block, candidates: DataFrame) -> DataFrame:
    """(item, row, doc_id, score) of the candidates (item, row); a text is read once for all its items."""
    schema = pa.schema([("item", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    documents, terms = index.documents, index.terms
    order = {number: k for k, number in enumerate(block.numbers)}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 500):
                out = {f.name: [] for f in schema}
                ids, numbers, sizes = part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(3).to_pylist()
                for row, doc_id, text, n, wanted in zip(part.column(0).to_pylist(), ids, text_bytes(part.column(2)), sizes, numbers):
                    tf = Counter(t for t in terms_of(text) if t in block.places)
                    place = np.fromiter((block.places[t] for t in tf), np.int64, len(tf))
                    value = impacts(np.fromiter(tf.values(), np.int64, len(tf)), length_norm(n, documents, terms))
                    column = [order[number] for number in wanted]
                    out["score"] += (value @ block.by_term[np.ix_(place, column)]).tolist()
                    out["item"] += wanted
                    out["row"] += [row] * len(wanted)
                    out["doc_id"] += [doc_id] * len(wanted)
                yield batch_of(out, schema)

    # At most the block's items in one array.
    wanted = stored(candidates.groupBy("row").agg(F.collect_set("item").alias("items")), "search-candidates")
    texts = index.sketches.select("row", "doc_id", "text", "n").join(wanted, "row")
    return texts.mapInArrow(scored, "item long, row long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = TOP, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Each row of ``items`` is an item by itself, repeated and null ids too; a null or empty text
    finds nothing. Equal scores are ranked by ascending doc_id, null last. An empty index or no
    items give no rows. Items go in blocks of about ``ITEMS``; sketches are read twice a block,
    texts only where a bound reaches the threshold.
    """
    spark = prepare(items)
    own = items.select("item_id", F.col("text").cast("string").alias("text"))
    asked = stored(own.withColumn("item", F.monotonically_increasing_id()), "search-items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    best = spark.createDataFrame([], "item long, row long, doc_id long, score long")
    for number in range(blocks if index.documents else 0):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        block = make_block(index, [(r["item"], (r["text"] or "").encode()) for r in some])
        if not block.places:
            continue
        tried = stored(exact_scores(index, block, highest_bounds(index, block, max(first, k))), "search-first")
        order = Window.partitionBy("item").orderBy(F.desc("score"))
        thresholds = tried.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("item", "score").collect()
        found = stored(exact_scores(index, block, reaching(index, block, dict(map(tuple, thresholds)))), "search-scores")
        best = best.unionByName(found.filter("score > 0"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
