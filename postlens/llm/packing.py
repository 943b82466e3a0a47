"""Operator 3: sum-of-squares packing of documents into sequences of a fixed length."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postlens.llm import tokens
from postlens.llm.common import prepare, stored

CAPACITY = 1024
#: Pieces of a group, about; what a task holds at once.
GROUP_PIECES = 20_000
#: A bin goes on to the next round if its gap is more than this share of the capacity.
LEAST_GAP = 1 / 64
#: Groups become fewer by this factor from round to round, as long as they keep their size.
FAN_IN = 32
NEVER = 1 << 60

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, part long"
_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("part", pa.int64()),
])


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, placed in the order given.

    An item goes to the bin, open or new, after which the sum over all gaps of the squared
    number of open bins with that gap is smallest; ties go to the smallest gap that fits.
    Full bins don't count. Items are at least 1 and at most ``capacity`` long.
    """
    open_bins = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 stays 0
    new, placed = 0, []
    for size in sizes:
        # by the gap of the bin taken, from ``size`` up: one bin less there, one more at what is left
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] -= 1  # a bin that becomes full leaves the sum
        change[count[size:] == 0] = NEVER
        best = int(change.argmin())
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = best + size
            chosen = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, chosen = capacity, new
            new += 1
        if gap > size:
            open_bins[gap - size].append(chosen)
            count[gap - size] += 1
        placed.append(chosen)
    return placed


def _placed(items: list[tuple], capacity: int, part: int, base: int, last: bool) -> dict:
    """Rows of one group's items (doc_id, piece, start, length, crc), packed from the longest down.

    ``part`` numbers the groups of a round, ``base`` those of all earlier rounds.
    """
    items.sort(key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[4]))
    bins = np.array(sum_of_squares([x[3] for x in items], capacity), np.int64)
    lengths = np.array([x[3] for x in items], np.int64)
    filled = np.bincount(bins, lengths, minlength=1).astype(np.int64)
    gaps = capacity - filled
    handed = (gaps > LEAST_GAP * capacity) & (not last)
    at = np.zeros(len(filled), np.int64)
    offsets = np.empty(len(items), np.int64)
    for k, (b, n) in enumerate(zip(bins.tolist(), lengths.tolist())):
        offsets[k] = at[b]
        at[b] += n
    return {
        "doc_id": [x[0] for x in items], "piece": [x[1] for x in items], "start": [x[2] for x in items], "length": lengths,
        "ids_crc32": [x[4] for x in items], "sequence_id": (base + part << 32) + bins, "offset": offsets, "open": handed[bins],
        "part": np.full(len(items), part),
    }


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = tokens.END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and the end id; only those longer than ``capacity`` are cut, into
    pieces of that length with the remainder first, so all but one piece of a document fill a
    sequence by themselves. The remainders are dealt by a hash of what they are to groups of about
    ``GROUP_PIECES``, so each group has the corpus's mix of lengths however the table is laid out,
    and packed from the longest down. All bins with a gap beyond ``LEAST_GAP`` are taken apart and
    dealt anew with another hash, round by round, until one group is left or a round leaves more
    than half of its pieces in such bins, when no mix fills them. The texts are not shuffled.
    Null texts are empty (one end id); repeated rows are packed each by itself; other columns
    are not read. An empty table gives no rows.
    """
    prepare(docs)
    tokenizer = tokenizer or tokens.default_path()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, end = TaskContext.get().partitionId(), tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        items, full, n_full = [], [], 0
        for batch in batches:
            for some in tokens.batches_of_bytes(batch, 1):
                for doc_id, raw in zip(some.column(0).to_pylist(), known.encode(some.column(1))):
                    raw += end
                    total = len(raw) // 4
                    head = total % capacity or capacity
                    items.append((doc_id, 0, 0, head, zlib.crc32(raw[: 4 * head])))
                    for piece, start in enumerate(range(head, total, capacity), 1):
                        # bins of whole pieces are numbered downwards from the end of the task's range
                        n_full += 1
                        sequence = (part << 32) + (1 << 32) - n_full
                        full.append((doc_id, piece, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), sequence, 0, False, part))
                if len(items) > 5_000:
                    heads = [(*x, None, None, True, part) for x in items]
                    yield pa.RecordBatch.from_pydict(dict(zip(_PIECE.names, zip(*heads))), schema=_PIECE)
                    items = []
                if len(full) > 5_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(_PIECE.names, zip(*full))), schema=_PIECE)
                    full = []
        if full:
            yield pa.RecordBatch.from_pydict(dict(zip(_PIECE.names, zip(*full))), schema=_PIECE)
        if items:
            heads = [(*x, None, None, True, part) for x in items]
            yield pa.RecordBatch.from_pydict(dict(zip(_PIECE.names, zip(*heads))), schema=_PIECE)

    def later_round(base: int, last: bool):
        def again(rows: pa.Table) -> pa.Table:
            table = rows.to_pydict()
            items = list(zip(*(table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))))
            return pa.Table.from_pydict(_placed(items, capacity, table["part"][0], base, last), schema=_PIECE)

        return again

    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first_round, PIECE_SCHEMA), "packed")
    out, waiting = rows.filter("not open"), rows.filter("open")
    base, left = rows.agg(F.max("part") + 1, F.count_if("open")).first()
    base, groups, before, rounds = base or 0, left, None, 0
    while left:
        groups = max(-(-left // GROUP_PIECES), -(-groups // FAN_IN) if rounds else 1)
        last = groups == 1 or before is not None and 2 * left > before
        # A null id tells nothing of its row, whose place stands in for it.
        identity = [F.coalesce("doc_id", F.monotonically_increasing_id()), F.col("start"), F.col("length"), F.col("ids_crc32")]
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.lit(rounds), *identity), F.lit(groups)))
        packed = stored(dealt.groupBy("part").applyInArrow(later_round(base, last), PIECE_SCHEMA), "packed")
        out, waiting = out.unionByName(packed.filter("not open")), packed.filter("open")
        base, before, rounds = base + groups, left, rounds + 1
        left = 0 if last else waiting.count()
    return out.drop("open", "part")
