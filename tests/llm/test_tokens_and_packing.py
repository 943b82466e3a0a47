import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import packing, token_files, tokens
from postlens.session import scratch_path

from .helpers import frame, odd_documents


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_lookup_equals_tokenizer(plain):
    rng = random.Random(3)
    parts = ["a", "b c", "\n", " ", "'s", "1", "é", "<|endoftext|>", "\t", "!", "\x1c", "don't", "\n\n", "漢字", "\x85", "Word,", "x.\nY"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    known = tokens.encoder(tokens.default_path())
    for text, raw in zip(texts, known.encode(pa.array(texts))):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind) == ids).all()


def test_crc_shift():
    a, b = b"hello", b"other bytes"
    assert token_files.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind,block", [("byte", 65_536), ("bit", 1_000)])
def test_token_files_round_trip(spark, plain, kind, block):
    rows = odd_documents()
    path = scratch_path(spark, "test-blocks")
    token_files.write_token_blocks(frame(spark, rows, ["row", "shard", "start"]), path, block_ids=block, plane_kind=kind)
    got = sorted(token_files.read_token_documents(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i, _, _ in rows if i is not None) and ids.count(None) == 2
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((i if i is not None else -1, len(x := ids_of(plain, t)), crc(x)) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_files_empty(spark):
    path = scratch_path(spark, "test-blocks")
    token_files.write_token_blocks(frame(spark, []), path)
    assert token_files.read_token_documents(spark, path).count() == 0


def brute_sum_of_squares(sizes, capacity):
    bins = []
    for size in sizes:
        best = None
        for k in [*range(len(bins)), len(bins)]:
            trial = bins[:k] + [(bins[k] if k < len(bins) else 0) + size] + bins[k + 1 :]
            if trial[k] > capacity:
                continue
            gaps = [capacity - b for b in trial if b < capacity]
            score = sum(gaps.count(g) ** 2 for g in set(gaps))
            key = (score, capacity - trial[k])
            if best is None or key < best[0]:
                best = (key, trial)
        bins = best[1]
    return bins


def test_sum_of_squares_rule():
    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randint(1, 20) for _ in range(40)]
        placed = packing.sum_of_squares(sizes, 20)
        fill = [0] * (max(placed) + 1)
        for b, s in zip(placed, sizes):
            fill[b] += s
        assert sorted(fill) == sorted(brute_sum_of_squares(sizes, 20))


def test_packing(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = odd_documents() * 3
    docs = frame(spark, rows, ["piece", "part", "open"]).repartition(7)
    got = packing.pack_documents(docs, capacity=256).toPandas()
    docs_got = []
    for _, one in got.sort_values(["doc_id", "piece"]).groupby(["doc_id", "piece", "start", "length", "ids_crc32"], dropna=False):
        docs_got.append(len(one))
    want = []
    for i, t, _ in rows:
        ids = ids_of(plain, t)
        head = len(ids) % 256 or 256
        for piece, (a, b) in enumerate([(0, head)] + [(k, k + 256) for k in range(head, len(ids), 256)]):
            want.append((-1 if i is None else i, piece, a, b - a, crc(ids[a:b])))
    have = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
    assert sorted(want) == sorted(map(tuple, have.to_numpy().tolist()))
    total = 0
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for offset, length in zip(one["offset"], one["length"]):
            assert offset == at
            at += length
        assert at <= 256
        total += 1
    assert total <= -(-sum(w[3] for w in want) // 256) * 1.1 + 2


def test_packing_of_a_table_sorted_by_length(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500, raising=False)
    long, short = "word " * 90, "word " * 60
    capacity = len(ids_of(plain, long)) + len(ids_of(plain, short))
    docs = frame(spark, [(k, long if k < 900 else short, "en") for k in range(1_800)]).repartitionByRange(2, "doc_id")
    got = packing.pack_documents(docs, capacity=capacity)
    assert got.count() == 1_800 and got.select("sequence_id").distinct().count() <= 900 * 1.02
    assert got.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {capacity}").count() == 0


def test_packing_empty(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
