import math
import random
import re

import pytest

from postlens.llm import quality

from .helpers import frame, odd_documents

SPACE = re.compile("[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = [x for x in SPACE.split(text) if x]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    places = {}
    for i, x in enumerate(windows):
        places.setdefault(x, []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    counts = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }
    counts["base_failed"] = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return counts


def repeated(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        n = rng.randint(0, 60)
        rows.append((k, rng.choice([" ", "\n", "\n\n"]).join(rng.choice("ab# cde|é") * rng.randint(1, 2) for _ in range(n)), "en"))
    return rows


def test_counts_equal_brute_force(spark):
    rows = odd_documents() + [(1000 + i, t, l) for i, t, l in repeated(3)]
    got = quality.judge(frame(spark, rows, ["n_words", "kept", "_words"])).collect()
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t, _ in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert {k: r[k] for k in want[r["doc_id"]]} == want[r["doc_id"]], r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.divergence("p", "q").alias("d"), quality.divergence("p", "p").alias("z")).first()
    assert row["d"] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and row["z"] == 0


def test_no_language_and_empty(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(50)), None), (2, None, None)]
    assert [r["kept"] for r in quality.judge(frame(spark, rows)).orderBy("doc_id").collect()] == [True, False]
    assert quality.judge(frame(spark, [])).count() == 0


def test_any_number_of_languages(spark):
    """The last of 300 languages in any order counts as much as the first."""
    text = lambda c: " ".join([c * 5] * 3 + [f"{c}{k}" for k in range(60)])
    rows = [(k, text("ab"), f"l{k:03}") for k in range(299)] + [(299, " ".join("漢字漢字%d" % k for k in range(60)), "zz")]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert len(got) == 300 and got[0]["kept"] and got[299]["kept"] and got[299]["class_distance"] < 0.01


def test_labelled_quality(spark):
    from postlens.llm.queries import QUERIES

    got = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.1")
    own = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("quality").agg({"kept": "count"}).count()
    assert own == 2
    rates = dict(got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").selectExpr("quality", "int(kept) k").groupBy("quality").avg("k").collect())
    assert rates[1] > 0.96 and rates[0] < 0.05


def test_plan_is_native(spark):
    from postlens.llm.queries import QUERIES

    plan = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
