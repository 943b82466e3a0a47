"""Operator 7: SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most d bits have a common variant within d/2 bits of each.
Over all 64 bits that is 2,081 variants each for d = 4, so the word is first cut into two
halves: one of them differs in at most d/2 bits, and the two meet in a variant of that half
within half of d/2 bits. That is 66 variants in all. Fingerprints that share a variant are
compared in full. A variant that very many fingerprints share is not compared pair by pair:
its fingerprints emit their variants over the whole word, within d/2 bits, where sharing one
proves the link, so that a minimum per variant is enough.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import NO_ID, components, free_name, pieces, prepare, stored, text_bytes

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of one variant that are compared pair by pair; larger groups take the other way.
PAIRWISE = 2_048
#: Pairs of several groups that are compared together, about.
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """64 bits, each set where over half of the shingles' hashes have it; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    plain, k = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(plain[a:b], 42) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4_096):
        counts += np.unpackbits(raw[at : at + 4_096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, digest, fp): the fingerprint as a signed long; the text's digest is null if not asked for."""
    prepare(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1_000):
                fps = np.array([fingerprint(t) for t in text_bytes(part.column(2))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], schema=schema)

    mark = text_digest() if digest else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), mark.alias("digest"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, digest string, fp long")


def text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)], np.uint64)


def _bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _local_roots(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (value, smallest value of its component) for edges between positions of ``values``."""
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _linked(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group [start, end) of an array sorted by group, as stars."""
    group = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.empty(0, int)
    left, right = [], []
    longest = int((ends - starts).max(initial=0))
    for step in range(1, longest):
        one, two = rows[:-step], rows[step:]
        both = group[:-step] == group[step:]
        one, two = one[both], two[both]
        near = _bit_counts(fps[one] ^ fps[two]) <= max_bits
        left.append(one[near])
        right.append(two[near])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    values, where = np.unique(fps[np.concatenate((a, b))], return_inverse=True)
    return _local_roots(values, where[: len(a)], where[len(a) :])


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, distinct), as spanning stars.

    Every two fingerprints within ``max_bits`` bits are joined by a path of links; every link
    is verified, or proved by a common variant of the whole word.
    """
    prepare(fps)
    half = _masks(32, max_bits // 2 // 2)
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    variant_schema = pa.schema([("variant", pa.int64()), ("fp", pa.int64())])

    def emit_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys: 33 bits of half number and variant."""
        for batch in batches:
            for part in pieces(batch, 4_000):
                x = np.asarray(part.column(0)).view(np.uint64)
                for number, word in ((0, x & low), (1, x >> shift)):
                    keys = ((word[:, None] ^ half[None, :]) | np.uint64(number << 32)).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(x, len(half)).view(np.int64))], schema=variant_schema)

    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by variant. Links of small groups; (fp, null) for members of large ones."""
        held_key, held_fp, large = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], schema=link_schema)

        def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            size = ends - starts
            for a, b in zip(starts[size > pairwise], ends[size > pairwise]):
                yield rows(fps[a:b], None)
            # groups of about the same size go together, so that the steps end soon
            for least, most in ((1, 2), (2, 8), (8, 64), (64, pairwise)):
                some = np.flatnonzero((size > least) & (size <= most))
                # so many groups at once that their pairs take little memory
                part = np.cumsum(size[some] ** 2) // PAIRS_AT_ONCE
                for own in np.split(some, np.flatnonzero(np.diff(part)) + 1):
                    a, b = _linked(fps, starts[own], ends[own], max_bits)
                    if len(a):
                        yield rows(a, b)

        for batch in batches:
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            if large is not None:  # the rest of a large group passes by unheld
                end = int(np.searchsorted(keys, large, "right"))
                if end:
                    yield rows(fps[:end], None)
                keys, fps = keys[end:], fps[end:]
                if not len(keys):
                    continue
                large = None
            keys, fps = np.concatenate((held_key, keys)), np.concatenate((held_fp, fps))
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from groups(keys[:last], fps[:last])
            held_key, held_fp = keys[last:].copy(), fps[last:].copy()
            if len(held_key) > pairwise:
                yield rows(held_fp, None)
                large, held_key, held_fp = int(held_key[0]), held_key[:0], held_fp[:0]
        if len(held_key):
            yield from groups(held_key, held_fp)

    ball = _masks(64, max_bits // 2)

    def emit_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 64):
                x = np.asarray(part.column(0)).view(np.uint64)
                keys = (x[:, None] ^ ball[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(x, len(ball)).view(np.int64))], schema=variant_schema)

    found = stored(
        fps.select("fp").mapInArrow(emit_halves, "variant long, fp long")
        .repartition("variant").sortWithinPartitions("variant").mapInArrow(compare, "a long, b long"), "simhash-links",
    )
    small = found.filter("b is not null")
    balls = found.filter("b is null").select(F.col("a").alias("fp")).distinct().mapInArrow(emit_balls, "variant long, fp long")
    centre = balls.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    proved = balls.join(centre, "variant").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return small.union(proved)


def group_firsts(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, first): the first row of each fingerprint's component, as (no id, doc_id, digest)."""
    nodes = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("low"))
    roots = components(links(nodes.select("fp"), max_bits), "a", "b", "simhash-components")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("low").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and empty texts have fingerprint zero and link like any other. ``component_id`` is the
    smallest non-null doc_id that can be reached (null where all are null). Equal fingerprints
    are one node, however many rows have them; repeated rows stay. Other columns are not read;
    an empty table gives no rows.
    """
    marked = stored(with_fingerprints(docs), "simhash")
    return marked.join(group_firsts(marked, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of the documents, all columns, with one row of each near-duplicate group.

    The row with the smallest doc_id stays; a null id comes last, and of rows with equal ids
    the one with the smallest digest of its text. Of rows equal in both, any one stays.
    """
    marked = stored(with_fingerprints(docs, digest=True), "simhash")
    stay = stored(group_firsts(marked, max_bits).select("first").distinct(), "simhash-stay")
    own_id, digest = free_name(docs, "id"), free_name(docs, "digest")
    keys = stay.select(F.coalesce("first.doc_id", F.lit(NO_ID)).alias(own_id), F.col("first.digest").alias(digest))
    own = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), digest: text_digest()})
    return own.join(keys, [own_id, digest], "left_semi").dropDuplicates([own_id, digest]).drop(own_id, digest)
