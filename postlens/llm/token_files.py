"""Operator 9: token ids in a bit-plane file format, and reading them back.

The format is a table of blocks. A block holds a fixed number of ids of one shard (the last of
a shard fewer); its unsigned 32-bit ids are transposed into 4 byte planes or 32 bit planes, and
each plane is compressed with zstandard by itself. The row of a block carries its place (shard,
number, first id, count), the planes' lengths, and the documents with ids in it, so the columns
without ``planes`` are the chunk index and can be read alone. Spark writes the table, so a task
that is repeated leaves nothing behind.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm import tokens
from postlens.llm.common import prepare

BLOCK_IDS = 65_536
ZSTD_LEVEL = 3

BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids int, plane_kind string, plane_bytes array<int>, planes array<binary>, "
    "docs array<struct<row:long,doc_id:long,at:int,n:int,after:long>>"
)
_DOC = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("after", pa.int64())])
_BLOCK = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("plane_kind", pa.string()),
    ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(_DOC)),
])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The ids' planes, least significant first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def crc_shift(crc: int, n_bytes: int) -> int:
    """The crc32 of data followed by ``n_bytes``, apart from what those bytes add by exclusive or."""
    def times(a: int, b: int) -> int:
        product, bit = 0, 1 << 31
        while bit:
            if a & bit:
                product ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
            bit >>= 1
        return product

    power, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            power = times(square, power)
        square = times(square, square)
        n >>= 1
    return times(power, crc)


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = tokens.END_ID,
    block_ids: int = BLOCK_IDS, plane_kind: str = "byte",
) -> None:
    """Ids of all documents in ascending doc_id order, as a table of blocks at ``path``.

    Only (doc_id, text) of the input is read; equal ids follow the texts' hash, null ids come
    first, and each row is a document of its own. Null and empty texts have the end id alone.
    One range shuffle of the texts; a task holds one block and one slice of texts.
    """
    prepare(docs)
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shard = TaskContext.get().partitionId()
        pack, known, end = zstandard.ZstdCompressor(level=ZSTD_LEVEL), tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        buffer, held, entries, number, first, row = [], 0, [], 0, 0, 0

        def block() -> pa.RecordBatch:
            planes = [pack.compress(p) for p in to_planes(np.frombuffer(b"".join(buffer), "<u4"), plane_kind)]
            values = [shard, number, first, held, plane_kind, [len(p) for p in planes], planes, entries]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for part in tokens.batches_of_bytes(batch, 1):
                ids = part.column(0).to_pylist()
                for doc_id, raw in zip(ids, known.encode(part.column(1))):
                    raw += end
                    done, total = 0, len(raw) // 4
                    while done < total:
                        take = min(total - done, block_ids - held)
                        entries.append({"row": row, "doc_id": doc_id, "at": held, "n": take, "after": total - done - take})
                        buffer.append(raw[4 * done : 4 * (done + take)])
                        held, done = held + take, done + take
                        if held == block_ids:
                            yield block()
                            buffer, entries, first, number, held = [], [], first + held, number + 1, 0
                    row += 1
        if held:
            yield block()

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("_order", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order")
        .drop("_order").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)
    )


def read_token_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Blocks decode independently. A document's checksum is the exclusive or of its pieces'
    checksums, each moved past the ids that follow, so pieces of one document meet in an
    ordinary partial aggregation.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in batch.to_pylist():
                raw = from_planes([unpack.decompress(p) for p in b["planes"]], b["n_ids"], b["plane_kind"]).tobytes()
                out = {"shard": [], "row": [], "doc_id": [], "start": [], "n": [], "crc": []}
                for d in b["docs"]:
                    crc = zlib.crc32(memoryview(raw)[4 * d["at"] : 4 * (d["at"] + d["n"])])
                    crc = crc_shift(crc, 4 * d["after"]) if d["after"] else crc
                    for key, value in zip(out, (b["shard"], d["row"], d["doc_id"], b["first"] + d["at"], d["n"], crc)):
                        out[key].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pieces_schema)

    pieces_schema = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
    found = blocks.select("shard", "first", "n_ids", "plane_kind", "planes", "docs").mapInArrow(
        decode, "shard int, row long, doc_id long, start long, n long, crc long"
    )
    documents = found.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"),
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    offsets = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return documents.join(offsets, "shard").select(
        "doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32"
    )
