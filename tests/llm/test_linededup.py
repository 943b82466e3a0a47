import random

import numpy as np
import pytest

from postlens.llm import linededup as L

from .helpers import frame, odd_documents, words


def brute(rows, least):
    """Words inside a window of ``least`` words that stands earlier too (not overlapping itself)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first, out = {}, {}
    for k in order:
        w = (rows[k][1] or "").split()
        covered = set()
        for i in range(len(w) - least + 1):
            x = tuple(w[i : i + least])
            if x in first and first[x] != (k, i):
                covered.update(range(i, i + least))
            first.setdefault(x, (k, i))
        out[k] = covered
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 120, 400)]
    rows = [(None, "", "en"), (None, None, "en"), (1, None, "en"), (2, " \n ", "en")]
    for k in range(40):
        text = []
        for _ in range(3):
            text += words(rng, rng.randint(0, 70)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((10 + k, rng.choice([" ", "\n", "  \n"]).join(text), "en"))
    rows.append((100, rows[20][1], "en"))  # an exact copy
    near = rows[21][1].split()
    near[len(near) // 2] = "changed"
    rows.append((101, " ".join(near), "en"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_go_and_the_rest_stays(spark, seed):
    rows = corpus(seed)
    got = {}
    for r in L.dedupe(frame(spark, rows, ["removed", "h", "at", "start"]).repartition(4)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    want, missed = brute(rows, L.LEAST_WORDS), 0
    for k, (i, text, _) in enumerate(rows):
        if i is None:
            continue
        (r,) = got[i]
        removed = {p for s in r["removed"] for p in range(s["start"], s["end"])}
        assert removed <= want[k], i
        missed += len(want[k] - removed)
        left = [w for p, w in enumerate((text or "").split()) if p not in removed]
        assert (r["text"] or "").split() == left
        if not removed:
            assert r["text"] == text
        assert r["at"] == "clash"
    assert missed < 0.05 * sum(map(len, want.values()))
    assert len((got[100][0]["text"] or "").split()) < L.WINDOW_LINES


def test_planted_passages_go_whole(spark):
    rng = random.Random(8)
    passages = [words(rng, n) for n in (50, 51, 75, 300)]
    rows = [(k, " ".join(words(rng, 30) + passages[k % 4] + words(rng, 40)), "en") for k in range(40)] + [(99, " ".join(words(rng, 500)), "en")]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in L.dedupe(frame(spark, rows)).collect()}
    for k in range(40):
        assert got[k] == ([] if k < 4 else [(30, 30 + len(passages[k % 4]))])
    assert got[99] == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    """Earlier texts hold pieces of the passages, so many fingerprints have a first place that shares no passage."""
    rng = random.Random(20 + seed)
    passages = [words(rng, n) for n in (50, 52, 60, 75, 130)]
    rows = corpus(seed)[4:]
    for k in range(60):
        passage = rng.choice(passages)
        a = rng.randrange(26)
        piece = passage[a : a + rng.randint(25, 60)] if k < 30 else passage
        rows.append((200 + k, " ".join(words(rng, 30) + piece + words(rng, 40)), "en"))
    x, own = words(rng, 80), words(rng, 30)
    rows.append((300, " ".join(x[:60] + own + x[10:45] + own[::-1] + x), "en"))  # and inside one text
    got = {r["doc_id"]: {p for s in r["removed"] for p in range(s["start"], s["end"])} for r in L.dedupe(frame(spark, rows).repartition(4)).collect()}
    want = brute(rows, L.LEAST_WORDS)
    for k, (i, _, _) in enumerate(rows):
        assert got[i] == want[k], i


def test_repeated_rows_and_long_texts(spark):
    rows = odd_documents()
    got = L.dedupe(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[14] == [rows[11][1]] and by[25] == ["", ""] and by[4] == [rows[5][1]]


def test_periodic_text_keeps_one_period(spark):
    text = " ".join(["lyon"] * 400)
    (r,) = L.dedupe(frame(spark, [(1, text, "fr")])).collect()
    assert r["text"] == "lyon"


def test_blocks_of_texts_equal_single_texts(spark, monkeypatch):
    rows = corpus(5)
    whole = {(r["doc_id"], r["text"]) for r in L.dedupe(frame(spark, rows)).collect()}
    found = L.fingerprints(frame(spark, rows)).collect()
    monkeypatch.setattr(L, "BLOCK_BYTES", 1)
    assert sorted(map(str, L.fingerprints(frame(spark, rows)).collect())) == sorted(map(str, found))
    assert {(r["doc_id"], r["text"]) for r in L.dedupe(frame(spark, rows)).collect()} == whole


def test_winnowing_guarantee():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 26).astype(np.uint64)
    for _ in range(50):
        a = np.concatenate((rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64), common, rng.integers(0, 2**63, 40).astype(np.uint64)))
        b = np.concatenate((rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64), common))
        assert set(a[L.winnow(a, 26)].tolist()) & set(b[L.winnow(b, 26)].tolist())


def test_line_hashes_depend_on_content_alone():
    rng, h = random.Random(6), L.LineHashes()
    line = [w.encode() for w in words(rng, 25)]
    a, b = [w.encode() for w in words(rng, 9000)] + line, [b"x"] + line + [b"y"]
    assert h(a, 25)[-1] == h(b, 25)[1] != h(b, 25)[0]


def test_empty(spark):
    assert L.dedupe(frame(spark, [])).count() == 0


def test_window_minima_equal_a_plain_search():
    rng = np.random.default_rng(2)
    for window in (1, 2, 3, 7, 16, 26):
        hashes = rng.integers(0, 40, 300).astype(np.uint64)  # many are equal
        plain = [int(k + hashes[k : k + window].argmin()) for k in range(len(hashes) - window + 1)]
        assert L.window_minima(hashes, window).tolist() == plain


def test_texts_without_cuts_are_not_shuffled(spark):
    rng = random.Random(8)
    passage = " ".join(words(rng, 60))
    rows = [(k, " ".join(words(rng, 80)), "en") for k in range(20)] + [(30, passage, "en"), (31, f"{passage} end", "en"), (32, None, "en")]
    out = L.dedupe(frame(spark, rows))
    cut = {r["doc_id"]: (r["text"], len(r["removed"])) for r in out.collect()}
    assert cut == {k: (t, 0) for k, t, _ in rows if k != 31} | {31: ("end", 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1, plan


def test_only_the_cuts_stay_stored(spark):
    import os

    from postlens.session import job_folder

    def folders():
        return set(os.listdir(job_folder(spark))) if os.path.isdir(job_folder(spark)) else set()

    before = folders()
    assert L.dedupe(frame(spark, corpus(5))).count() == len(corpus(5))
    assert [name.rsplit("-", 1)[0] for name in folders() - before] == ["repeat-cuts"]


def test_words_of_many_texts_at_once():
    rng, h = random.Random(9), L.LineHashes()
    texts = [b"", b" \n", b" a  b\t", "é x\x0b\r\ny".encode(), b"z"] + [" ".join(words(rng, n)).encode() for n in (3, 70)]
    sums, sizes = h.sums(texts)
    split = [t.split() for t in texts]
    assert sizes.tolist() == list(map(len, split))
    at = np.arange(sizes.sum())
    assert h.spans(sums, at, at + 1).tolist() == [h([w], 1)[0] for t in split for w in t]


def test_second_places_equal_a_plain_search():
    rng = np.random.default_rng(7)
    for most in (3, 40, 2**60):
        keys, text = rng.integers(0, most, 200).astype(np.uint64), np.sort(rng.integers(0, 5, 200))
        seen, plain = set(), []
        for x in zip(text.tolist(), keys.tolist()):
            plain.append(x in seen)
            seen.add(x)
        assert L.second_places(keys, text).tolist() == plain


def test_portions_hold_every_row_and_few_bytes():
    import pyarrow as pa

    texts = ["", None, "abc", "x" * 50, "é" * 3, "", "ab", None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": texts})
    parts = [p.to_pydict() for p in L.portions(batch, 1, 10)]
    assert [k for p in parts for k in p["k"]] == list(range(8))
    assert all(len(p["t"]) == 1 or sum(len((t or "").encode()) for t in p["t"]) <= 10 for p in parts)


def test_workers_are_kept_small():
    """What a task holds counts twice or more in an executor: no pandas, and small blocks."""
    import subprocess
    import sys
    import tracemalloc

    code = "import sys, postlens.llm.linededup; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"
    assert L.BLOCK_BYTES <= 250_000
    text = " ".join(words(random.Random(3), 40_000)).encode()[: L.BLOCK_BYTES]
    tracemalloc.start()
    L.LineHashes().sums([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000, peak
