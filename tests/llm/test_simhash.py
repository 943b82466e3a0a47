import random

import numpy as np
import pytest
import xxhash

from postlens.llm import simhash
from postlens.llm.common import components

from .helpers import frame, odd_documents, words


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, f"{f:016x}", low.get(find(k))) for k, ((i, _, _), f) in enumerate(zip(rows, fps))]


def near_rows(seed):
    rng = random.Random(seed)
    rows = odd_documents(seed)
    for k in range(12):
        base = words(rng, 150)
        for copy in range(12):
            some = list(base)
            for _ in range(copy % 4):
                some[rng.randrange(150)] = "changed"
            rows.append((100 + 20 * k + copy, " ".join(some), "en"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    got = simhash.near_duplicates(frame(spark, rows, ["fp", "root", "variant"]).repartition(5)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows), key=key)


@pytest.mark.parametrize("pairwise", [2_048, 2, 1])
def test_links_span_all_close_pairs(spark, pairwise):
    """With a small bound most groups go the way of whole-word balls; the classes stay the same."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 7)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), pairwise=pairwise).collect()
    seen = set(signed)
    for a, b in edges:
        assert a in seen and b in seen
    def classes(pairs):
        root = {f: f for f in signed}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {f: find(f) for f in signed}
    near = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert classes(edges) == classes(near)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()))
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
