"""Operator 6: repeated passages by winnowing over line hashes.

A line is ``LINE_WORDS`` consecutive words, starting at any word, so that a passage need not
begin where a line break stands. The smallest hash of every window of consecutive lines is a
fingerprint; any passage of ``LEAST_WORDS`` words that two texts share has one in common.
A fingerprint speaks for the windows whose smallest hash it is, and so for all places of these
windows. Where all places of a fingerprint agree in them, the later ones are cut; where they
differ, each window is hashed by itself and looked up at its own first place.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlens.functions.bloom import BloomFilter
from postlens.llm.common import NO_ID, ROW_BATCH_BYTES, drop_shuffles, forget, free_name, prepare, stored, text_bytes

LEAST_WORDS = 50
LINE_WORDS = 25
#: Lines of a window; the guarantee is LINE_WORDS + WINDOW_LINES - 1 words.
WINDOW_LINES = LEAST_WORDS - LINE_WORDS + 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)  # modulo 2**64


class LineHashes:
    """Polynomial hashes of all lines of a list of words at once; the power tables grow with the longest list met."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 14), _powers(_INVERSE, 1 << 14)

    def __call__(self, words: list[bytes], line_words: int) -> np.ndarray:
        first = np.arange(len(words) - line_words + 1)
        return self.spans(self.sums(words)[0], first, first + line_words)

    def sums(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Sums up to every byte of the words of all texts, one space after each, and where each word
        starts and ends; and the number of words of each text."""
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        end = space.copy()  # the first space after a word
        end[:1] = False
        end[1:] &= ~space[:-1]
        keep = ~space
        keep |= end
        sizes = np.searchsorted(np.flatnonzero(end), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        raw, ends = raw[keep], np.flatnonzero(end[keep])
        raw[ends] = 0x20
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(_BASE, len(raw) * 5 // 4), _powers(_INVERSE, len(raw) * 5 // 4)
        total = np.zeros(len(raw) + 1, np.uint64)
        by_byte = raw + np.uint64(1)
        by_byte *= self.up[: len(raw)]
        np.cumsum(by_byte, out=total[1:])
        return (total, np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1)), ends), np.diff(sizes, prepend=0)

    def spans(self, sums: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The hash of each span of words [first, until)."""
        total, starts, ends = sums
        x = (total[ends[until - 1]] - total[starts[first]]) * self.down[starts[first]]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest hash of each window, the first of equal ones.

    Two windows that overlap or touch make a longer one, so lengths double up to the window's.
    """
    place, value, length = np.arange(len(hashes)), hashes, 1
    while length < window:
        step = min(length, window - length)
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value = np.minimum(value[:-step], value[step:])
        length += step
    return place


def smallest_lines(hashes: np.ndarray, window: int, text: np.ndarray | None = None, line_words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The first lines of all whole windows, in order, and the place of each one's smallest hash, the first of equal ones.

    ``text`` tells the text of each word, where several texts follow one another; windows that
    reach from one into the next don't count.
    """
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.arange(len(hashes) - window + 1)
    smallest = window_minima(hashes, window)
    if text is not None:
        last = line_words + window - 2
        whole = text[: len(smallest)] == text[last : last + len(smallest)]
        return starts[whole], smallest[whole]
    return starts, smallest


def winnow(hashes: np.ndarray, window: int, text: np.ndarray | None = None, line_words: int = 1) -> np.ndarray:
    """Places of the smallest hash of every window; none if there is no whole window."""
    return np.unique(smallest_lines(hashes, window, text, line_words)[1])


def second_places(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which keys, in the order of their places, stand earlier in the same text."""
    out = np.zeros(len(keys), bool)
    # Most keys stand once: equal ones are equal with their text's number mixed in, and only these are ordered by place.
    both = keys ^ text.astype(np.uint64) * np.uint64(_BASE)
    ascending = np.sort(both)
    twice = ascending[1:][ascending[1:] == ascending[:-1]]
    if len(twice):
        some = np.flatnonzero(twice[np.searchsorted(twice[:-1], both)] == both)
        keys, text = keys[some], text[some]
        order = np.lexsort((keys, text))
        out[some[order[1:]]] = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    return out


def united(row: np.ndarray, start: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, those of a row that overlap or touch as one, in order."""
    if not len(row):
        return row, start, until
    order = np.lexsort((start, row))
    apart = row[order].astype(np.int64) << 32  # spans of different rows never meet
    first, last = start[order] + apart, np.maximum.accumulate(until[order] + apart)
    new = np.concatenate(([True], first[1:] > last[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))
    return row[order][new], (first - apart)[new], last[ends] - apart[ends]


def _place() -> tuple[Column, Column]:
    """A text's id and mark: a null id comes first; rows equal in id and text are one place."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


#: Bytes of text that are worked on at once; a longer text is taken alone.
BLOCK_BYTES = 250_000


def portions(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of rows with at most ``most`` bytes in their texts, or of one longer text."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    until, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(until, until[at] - sizes[at] + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def fingerprints(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(h, id, mark, at, start, until, context): selected line hashes with their text and first word.

    ``start`` to ``until`` are the words of all windows whose smallest hash this one is, and
    ``context`` is their hash. Rows without ``h`` are spans that repeat words of the same text;
    a fingerprint all of whose windows are such repeats is left out.
    """
    prepare(docs, ROW_BATCH_BYTES)
    window = least_words - line_words + 1
    kind = "h long, id long, mark long, at int, start int, until int, context long"
    long, short = pa.int64(), pa.int32()
    schema = pa.schema([("h", long), ("id", long), ("mark", long), ("at", short), ("start", short), ("until", short), ("context", long)])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_hashes = LineHashes()

        def block(part: pa.RecordBatch) -> pa.RecordBatch | None:
            sums, sizes = line_hashes.sums(text_bytes(part.column(2)))
            first = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(sizes)), sizes)
            line = np.arange(len(text) - line_words + 1)
            hashes = line_hashes.spans(sums, line, line + line_words)
            starts, smallest = smallest_lines(hashes, window, text, line_words)
            if not len(starts):
                return None
            again = second_places(line_hashes.spans(sums, starts, starts + least_words), text[starts])
            # The windows of a fingerprint follow one another.
            places, begin, n = np.unique(smallest, return_index=True, return_counts=True)
            keep = np.add.reduceat(~again, begin, dtype=np.int64) > 0
            places, start, until = places[keep], starts[begin][keep], (starts[begin] + n - 1 + least_words)[keep]
            context = line_hashes.spans(sums, start, until)
            # Runs of repeats inside the text, as spans.
            s = starts[again]
            edge = np.flatnonzero((np.diff(s) > least_words) | (np.diff(text[s]) != 0)) + 1 if len(s) else np.empty(0, np.int64)
            a = s[np.concatenate(([0], edge))] if len(s) else s
            b = (s[np.concatenate((edge - 1, [-1]))] if len(s) else s) + least_words
            own = np.concatenate((text[places], text[a]))
            ids, marks = (part.column(k).to_numpy()[own] for k in (0, 1))
            none = np.zeros(len(a), np.int64)
            absent = np.arange(len(own)) >= len(places)
            from_first = lambda x, y: (np.concatenate((x, y)) - first[own]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((hashes[places].view(np.int64), none)), mask=absent), pa.array(ids), pa.array(marks),
                pa.array(from_first(places, a)), pa.array(from_first(start, a)), pa.array(from_first(until, b)),
                pa.array(np.concatenate((context.view(np.int64), none)), mask=absent),
            ], schema=schema)

        for batch in batches:
            for part in portions(batch, 2, BLOCK_BYTES):
                found = block(part)
                if found is not None:
                    yield found

    own_id, mark = _place()
    return docs.select(own_id.alias("id"), mark.alias("mark"), F.col("text").cast("string")).mapInArrow(select, kind)


def window_hashes(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """(h, w, id, mark, at): every window of the wanted fingerprints (h, id, mark, start, until) with its hash."""
    asked = wanted.groupBy("id", "mark").agg(F.collect_set(F.struct("h", "start", "until")).alias("asked"))
    own_id, mark = _place()
    own = docs.select(own_id.alias("id"), mark.alias("mark"), F.col("text").cast("string"))
    kind = "h long, w long, id long, mark long, at int"
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("at", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_hashes = LineHashes()
        for batch in batches:
            for part in portions(batch, 2, BLOCK_BYTES):
                sums, sizes = line_hashes.sums(text_bytes(part.column(2)))
                row = np.repeat(np.arange(len(sizes)), part.column(3).value_lengths().to_numpy())
                flat = part.column(3).flatten()
                h, start, until = (flat.field(c).to_numpy() for c in ("h", "start", "until"))
                n = until - start - least_words + 1
                k = np.repeat(np.arange(len(n)), n)
                at = start[k] + np.arange(len(k)) - (np.cumsum(n) - n)[k]
                place = at + (np.cumsum(sizes) - sizes)[row[k]]
                w = line_hashes.spans(sums, place, place + least_words).view(np.int64)
                ids, marks = (part.column(c).to_numpy()[row[k]] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[k], w, ids, marks, at.astype(np.int32))], schema=schema)

    return own.join(asked, ["id", "mark"]).select("id", "mark", "text", "asked").mapInArrow(cut, kind)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words, each up to the next word that stays."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    begins = ~space
    begins[1:] &= space[:-1]
    places = np.flatnonzero(begins)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a]])
        at = places[b] if b < len(places) else len(text)
    out.append(text[at:])
    left = b"".join(out)
    return left.rstrip(b" \t\n\r\x0b\x0c") if spans[-1][1] >= len(places) else left


def dedupe(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """Every row, all columns, with later repeats cut out of ``text`` and their word spans in ``removed``.

    A word goes if it lies in ``least_words`` words that stand at an earlier place, by doc_id and
    then by position; a null id comes first. Words count as the same where two hashes of 64 bits
    are, that of the fingerprint and that of the words (inside one text the latter alone).
    Within a text a repeat may overlap what it repeats, so of a text with a short period one
    period stays. Rows equal in id and text are one place and are treated alike. Spans count words between
    ASCII white space. Texts of fewer than ``least_words`` words can't hold a passage and stay
    as they are, null and empty ones too. A ``removed`` column of the input is replaced.

    Two joins move texts: one for the fingerprints whose places differ, one for the cuts; of the latter
    a Bloom filter of the cut texts holds back the others, which aren't shuffled. A passage
    that any share of the texts repeat is a hot key only where Spark can split the join.
    """
    spark = prepare(docs, ROW_BATCH_BYTES)
    drop_shuffles(spark)
    docs = docs.drop("removed")
    found = stored(fingerprints(docs, least_words, line_words), "winnowed")
    place = F.struct("id", "mark", "at")
    # The windows' words and where the line lies in them; the two lengths as one number.
    words = [F.col("context"), F.shiftleft((F.col("at") - F.col("start")).cast("long"), 32) + F.col("until") - F.col("start")]
    lines = found.filter("h is not null")
    mixed = (F.min(words[0]) != F.max(words[0])) | (F.min(words[1]) != F.max(words[1]))
    groups = lines.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), mixed.alias("mixed"))
    # Each step's result is written, so that its shuffle files, and the results that only it reads, can go
    # before the next step's are made.
    shared = stored(groups.filter("first != last").select("h", "first", "mixed"), "repeated-lines")
    drop_shuffles(spark)
    met = stored(lines.join(shared, "h").filter(F.col("mixed") | (place != F.col("first"))).select("h", "id", "mark", "start", "until", "mixed"), "repeats")
    own = stored(found.filter("h is null").select("id", "mark", "start", "until"), "own-repeats")
    forget(shared)
    forget(found)
    drop_shuffles(spark)
    windows = stored(window_hashes(docs, met.filter("mixed"), least_words), "repeat-windows")
    drop_shuffles(spark)
    firsts = windows.groupBy("h", "w").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h", "w", "first")
    later = windows.join(firsts, ["h", "w"]).filter(place != F.col("first"))
    spans = [
        later.select("id", "mark", F.col("at").alias("start"), (F.col("at") + least_words).alias("until")),
        met.filter("not mixed").select("id", "mark", "start", "until"),
        own,
    ]
    own_id, own_mark, own_key, slices_of = (free_name(docs, name) for name in ("id", "mark", "key", "slices"))
    cuts = stored(spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy(F.col("id").alias(own_id), F.col("mark").alias(own_mark)).agg(
        F.collect_set(F.struct("start", "until")).alias(slices_of)), "repeat-cuts")
    for done in (windows, met, own):
        forget(done)
    drop_shuffles(spark)

    columns = docs.columns
    number = columns.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, number, BLOCK_BYTES):
                slices = part.column(len(columns))
                some = slices.flatten()
                row = np.repeat(np.arange(len(slices)), slices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                row, first, last = united(row, *(some.field(c).to_numpy() for c in ("start", "until")))
                until = np.cumsum(np.bincount(row, minlength=len(slices)))
                if len(row):
                    texts, spans, at = part.column(number).to_pylist(), list(zip(first.tolist(), last.tolist())), 0
                    for k, end in enumerate(until.tolist()):
                        if end > at:
                            texts[k] = without(texts[k].encode(), spans[at:end]).decode()
                        at = end
                    part = part.set_column(number, part.schema.field(number), pa.array(texts, part.schema.field(number).type))
                pairs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], fields=list(spans_type.value_type))
                removed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], until)), pa.int32()), pairs)
                arrays = [part.column(k) for k in range(len(columns))] + [removed]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "removed"])

    keyed = docs.withColumns(dict(zip((own_id, own_mark), _place())))
    key = F.xxhash64(own_id, own_mark).alias(own_key)
    likely, whole = BloomFilter.of(cuts.select(key), own_key).split(keyed.select("*", key), own_key)
    joined = likely.join(cuts, [own_id, own_mark], "left").select(*columns, slices_of)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(span))])
    return joined.mapInArrow(cut, kind).unionByName(whole.select(*columns, F.array().cast(kind["removed"].dataType).alias("removed")))
