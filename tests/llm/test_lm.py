import collections
import math
import random

import numpy as np
import pytest

from postlens.llm import lm

from .helpers import frame, odd_documents, words


def brute(rows, held):
    split = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for (i, t, _), h in zip(rows, held) if not h for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t, _), h in zip(rows, held):
        w = split(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base))
    return out


def table(spark, rows, held):
    return frame(spark, rows, ["block", "word", "number"]).withColumn("held_out", __import__("pyspark.sql.functions", fromlist=["x"]).expr(held))


@pytest.mark.parametrize("block_tokens", [2_000_000, 300])
def test_counts_and_base_score(spark, block_tokens):
    rng = random.Random(3)
    rows = odd_documents() + [(100 + k, " ".join(rng.choice(["The", "cat", "sat", "x%d" % k]) for _ in range(rng.randint(0, 40))), "en") for k in range(60)]
    docs = table(spark, rows, "coalesce(doc_id % 10 = 0, false)").repartition(4)
    got = lm.score(docs, classes=16, block_tokens=block_tokens).collect()
    want = brute(rows, [i is not None and i % 10 == 0 for i, _, _ in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    have = sorted(map(tuple, got), key=key)
    assert len(have) == len(rows)
    for h, w in zip(have, sorted(want, key=key)):
        assert h[:5] == w[:5] and h[5] == pytest.approx(w[5], rel=1e-9)
        assert h[6] < 0 and math.isfinite(h[6])


def test_probabilities_are_normalised():
    rng = np.random.default_rng(2)
    noise = rng.random(9)
    model = lm.Parameters(9, 4, noise / noise.sum())
    one, two = rng.integers(0, 10, 50), rng.integers(0, 10, 50)
    total = sum(np.exp(model.log_probability(one, two, np.full(50, w))) for w in range(9))
    assert total == pytest.approx(np.ones(50), rel=1e-5)
    again = lm.Parameters(9, 4, noise / noise.sum(), seed=5).load(model.rows())
    assert (again.rows() == model.rows()).all()


def test_training_learns_the_context():
    """Words follow one another in a fixed cycle: the model must come near to certainty."""
    n = 6
    model = lm.Parameters(n, 8, np.full(n, 1 / n))
    word = np.arange(20_000) % (n - 1)
    one, two = np.roll(word, 1), np.roll(word, 2)
    before = model.log_probability(one, two, word).mean()
    model.train(one, two, word, np.random.default_rng(1), model.fresh_squares())
    assert model.log_probability(one, two, word).mean() > -0.3 > before


def test_every_word_has_a_class_and_both_levels_sum_to_one(spark):
    """Over all known words and one unknown of each group, the probability after any context is one."""
    rng = random.Random(8)
    known = [f"{rng.choice('abcdef')}{k}" for k in range(400)]
    docs = table(spark, [(k + 1, " ".join(rng.choice(known[: 40 * (k % 9 + 1)]) for _ in range(50)), "en") for k in range(200)], "false").repartition(3)
    words = sorted({w for r in docs.collect() for w in r["text"].split()})
    alone = [(10_000 + k, w, "en") for k, w in enumerate(words)] + [(20_000, "", "en")]
    both = docs.unionByName(table(spark, alone, "true"))
    got = {r["doc_id"]: r for r in lm.score(both, classes=5).collect()}
    # P(w | start) = P(w, end) / P(end | w): compare with the classes' own sums instead
    classes = lm.Classes([b"", b"a"], 7)
    assert classes.n == 9 and classes.of([b"a", b"", b"xyzab", b"zab"]).tolist()[:2] == [1, 0]
    assert classes.of([b"xyzab"])[0] == classes.of([b"1yzab"])[0] >= 2
    assert all(got[i]["n_known"] == 2 and got[i]["train_tokens"] == 200 * 51 for i, _, _ in alone[:-1])
    total = sum(10 ** got[i]["score"] for i, _, _ in alone)
    assert 0 < total <= 1 + 1e-6  # texts of one word or none are disjoint events


def test_training_visits_every_token_once(spark, monkeypatch):
    docs = table(spark, [(k, "a b c d e f g", "en") for k in range(1, 40)], "doc_id % 10 = 0").coalesce(1)
    blocks = lm.blocks_of(docs, 100)
    classes = lm.Classes([b"a", b""], 3)
    seen = [r["weight"] for n in range(2) for r in lm.learned(blocks, classes, lm.Parameters(5, lm.DIMENSIONS, np.full(5, 0.2)), n, 2).groupBy().agg({"weight": "sum", "row": "max"}).withColumnRenamed("sum(weight)", "weight").collect()]
    rows = len(lm.Parameters(5, lm.DIMENSIONS, np.full(5, 0.2)).rows())
    assert sum(seen) / rows == 36 * 8  # 39 texts, 3 held out, seven words and the end


def test_empty_and_nothing_to_learn_from(spark):
    assert lm.score(table(spark, [], "false")).count() == 0
    got = lm.score(table(spark, [(1, "a b", None), (2, None, None)], "true")).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}


def test_beats_the_base_on_held_out_texts(spark):
    from postlens.llm.queries import QUERIES

    got = QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").selectExpr("sum(base_score) b", "sum(score) s", "count(*) n").first()
    assert got["n"] > 800 and got["s"] > got["b"]


def test_probabilities_equal_the_plain_formula_for_short_and_long_vectors():
    import numpy as np

    from postlens.llm import lm

    rng = np.random.default_rng(7)
    for scale in (1, 40):  # scores beyond e^88 would not be floats
        model = lm.Parameters(500, lm.DIMENSIONS, np.full(500, 1 / 500))
        model.target *= scale
        model.context *= scale
        one, two, word = rng.integers(0, 501, 3_000), rng.integers(0, 501, 3_000), rng.integers(0, 500, 3_000)
        scores = model.hidden(one, two).astype(np.float64) @ model.target.T.astype(np.float64) + model.bias
        top = scores.max(axis=1, keepdims=True)
        plain = (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[np.arange(3_000), word]
        assert np.allclose(model.log_probability(one, two, word), plain, rtol=1e-4, atol=1e-3)


def test_class_sums_take_exponentials_of_words_not_of_contexts(monkeypatch):
    """All contexts of 40 words: sums as by the plain formula, in tiles, and few exponentials."""
    rng, n = np.random.default_rng(6), 39
    model = lm.Parameters(n, 8, np.full(n, 1 / n))
    model.target, model.bias = rng.normal(0, 1, (n, 8)).astype(np.float32), rng.normal(0, 1, n).astype(np.float32)
    model.context = rng.normal(0, 1, (n + 1, 8)).astype(np.float32)
    one, two = (x.ravel() for x in np.divmod(np.arange((n + 1) ** 2), n + 1))
    plain = np.log(np.exp((model.hidden(one, two) @ model.target.T + model.bias).astype(np.float64)).sum(axis=1))
    taken, real = [], np.exp
    monkeypatch.setattr(lm, "TILE", 16)
    monkeypatch.setattr(lm.np, "exp", lambda x, **options: (taken.append(np.size(x)), real(x, **options))[1])
    got = model.log_totals(one, two)
    sparse = rng.choice(len(one), 60, replace=False)
    sparse.sort()
    few = model.log_totals(one[sparse], two[sparse])
    monkeypatch.undo()
    assert np.allclose(got, plain, atol=1e-4) and np.allclose(few, plain[sparse], atol=1e-4)
    assert sum(taken) < len(one) * n / 5


def test_run_sums():
    rows = np.random.default_rng(7).random((50, 6)).astype(np.float32)
    cuts = np.array([0, 1, 4, 30])
    for width in (5, 6):
        table = np.ascontiguousarray(rows[:, :width])
        assert np.allclose(lm._run_sums(table, cuts), np.add.reduceat(table, cuts, axis=0), rtol=1e-5)
