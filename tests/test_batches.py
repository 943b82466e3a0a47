"""Token arrays by Arrow batch: the same rows as place by place, and no walk over places left in the plan."""

import random

import pyarrow as pa

from postlens.operators import tokens as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_categories_by_batch(spark):
    rng = random.Random(4)
    names = [(c, f"k{k}", f"n{rng.randrange(6)}") for k in range(12) for c in rng.sample(["a", "b", "c"], rng.randrange(1, 4))] + [("a", "k1", None), ("z", "k2", "n")]
    rows = [(i, None if i % 17 == 0 else [rng.choice([None, "x", f"K{rng.randrange(14)}"]) for _ in range(rng.randrange(6))]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    dictionary = spark.createDataFrame(names, "category string, key string, name string")
    out = T.classify_tokens_multi(df, "tokens", dictionary, ["a", "b", "c"], prefix="p_")
    want = {i: tuple(", ".join(sorted({n for c, k, n in names if c == cat and n and k in {t.lower() for t in tokens or [] if t}})) for cat in "abc") for i, tokens in rows}
    assert {r.id: (r.p_a, r.p_b, r.p_c) for r in out.collect()} == want
    assert "ArrowEvalPython" in plan(out) and "array_distinct" not in plan(out)
    nothing = T.classify_tokens_multi(df, "tokens", dictionary.filter("false"), ["a"])
    assert {r.a for r in nothing.collect()} == {""}


def test_terms_by_batch(spark):
    rng = random.Random(5)
    texts = [None if i % 13 == 0 else " ".join(rng.choices("abc", k=rng.randrange(9))) for i in range(300)]
    terms = ["a b", "a b c", "c c", "b c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    out = T.dictionary_tokenize(df, "text", listed)
    joined = T.dictionary_tokenize(df, "text", listed, max_entries=0)
    assert {r.id: r.tokens for r in out.collect()} == {r.id: r.tokens for r in joined.collect()}
    assert "ArrowEvalPython" in plan(out) and "aggregate(" not in plan(out)


def test_slices_of_a_batch():
    from postlens.functions.batches import _coded

    lists = pa.array([["a"], None, ["b", None, "a"], []]).slice(1)
    names, code, sizes = _coded(lists)
    assert [names[k] for k in code] == ["b", None, "a"] and list(sizes) == [0, 3, 0]
