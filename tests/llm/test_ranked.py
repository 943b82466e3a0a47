import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.llm import ranked as R
from tests.llm.helpers import frame, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=R.TOP):
    """Every item against every document, as the score is defined."""
    known = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    known = [d for d in known if d[2]]
    n_docs, n_terms = len(known), sum(d[2] for d in known)
    df = Counter(t for _, tf, _ in known for t in tf)
    out = []
    for item, text in items:
        scores = []
        for doc_id, tf, n in known:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in plain_terms(text) if t in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, place, None if none else doc_id, -score) for place, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def result(spark, docs, items, extra=(), **options):
    rows = frame(spark, [(i, t, "en") for i, t in docs], extra=extra).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("clash"))
    found = R.search(R.build_index(rows), asked, **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=repr)


def zipf_texts(seed, n, words=120):
    rng = random.Random(seed)
    return [" ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.choice([3, 20, 60]))) for _ in range(n)]


def test_terms_are_the_contracts():
    for text in ("Ab1-c_d É漢字Ü x\x00y\x7fz [q]`{}~ 00", "", " ", "ſK"):
        assert [t.decode() for t in R.terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("coordinates,first,k", [(1 << 16, 64, 20), (16, 3, 3), (1, 1, 1)])
def test_equal_to_full_evaluation(spark, monkeypatch, coordinates, first, k):
    """Also where terms share coordinates, so that bounds are loose, and where few documents set the threshold."""
    monkeypatch.setattr(R, "COORDINATES", coordinates)
    texts = zipf_texts(k, 150)
    docs = list(enumerate(texts)) + [(1_000 + i, t) for i, t in enumerate(texts[:30])] + [(500, texts[0])] * 2 + [(600, "w1 " * 700), (601, "w1 " * 300 + "w2")]
    items = [(i, t) for i, t in enumerate(zipf_texts(99, 8))] + [(8, "w1"), (8, "w1 w1 w2"), (9, "never seen"), (None, "w3"), (10, None), (11, "")]
    assert result(spark, docs, items, k=k, first=first) == brute_force(docs, items, k)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(R, "ITEMS", 2)
    docs, items = list(enumerate(zipf_texts(1, 60))), list(enumerate(zipf_texts(2, 7)))
    assert result(spark, docs, items) == brute_force(docs, items)


def test_odd_documents_with_clashing_names(spark):
    docs = [(i, t) for i, t, _ in odd_documents()]
    items = [(1, "ünï Ünï 漢字"), (2, "x y"), (3, "endoftext ll"), (4, docs[12][1])]
    assert result(spark, docs, items, extra=("row", "n", "at", "most", "term", "df")) == brute_force(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, None), (2, " - ")], [(1, "a")]) == []
    assert result(spark, [(1, "a b")], []) == []


def test_bounds_are_never_below_scores(monkeypatch):
    monkeypatch.setattr(R, "COORDINATES", 8)
    rng = np.random.default_rng(4)
    places = {f"t{k}".encode(): k for k in range(40)}
    by_term = rng.integers(0, 9_000, (40, 5))
    hashed = np.array([R.zlib.crc32(t) % 8 for t in places])
    coordinates, column = np.unique(hashed, return_inverse=True)
    by_coordinate = np.zeros((len(coordinates), 5))
    np.add.at(by_coordinate, column, by_term)
    bounds = R.Bounds(R.Block(list(range(5)), places, by_term, coordinates, by_coordinate), 100, 5_000)
    for _ in range(50):
        tf = rng.integers(0, 4, 40) * rng.integers(1, 200, 40)
        n = int(tf.sum())
        if not n:
            continue
        most = np.array([min(R.MOST, max(tf[hashed == c], default=0)) for c in range(8)])
        used = np.flatnonzero(most)
        part = pa.RecordBatch.from_pydict({
            "row": [1], "n": [n], "at": [used.astype("<u2").tobytes()], "most": [most[used].astype(np.uint8).tobytes()],
        })
        score = R.impacts(tf, R.length_norm(n, 100, 5_000)) @ by_term
        assert (bounds(part)[0] >= score).all()
