import random
import re

import pytest

from postlens.llm import decontaminate as D

from .helpers import frame, odd_documents


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                ids = windows.get(tuple(w[s : s + n]))
                if ids:
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def planted(seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(["a", "B", "Éc", "éc", "d1", "rare%d" % rng.randrange(30)]) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(25)] + [(None, "Null id item"), (3, "same id again " * 5), (98, None), (99, "")]
    rows = []
    for k in range(80):
        own = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            part = (items[rng.randrange(len(items))][1] or "").split()
            a = rng.randint(0, max(0, len(part) - 5))
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in part[a : a + 20]]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(own), "en"))
    return odd_documents(seed) + rows + rows[:3], items


@pytest.mark.parametrize("seed,size", [(1, 13), (2, 13), (3, 4)])
def test_equals_brute_force(spark, seed, size):
    rows, items = planted(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(frame(spark, rows, ["items", "window", "term", "key"]), bench, size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=key)
    assert have == sorted(brute(rows, items, size), key=key)
    assert {"window", "term", "key"} <= set(got[0].asDict())


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(frame(spark, []), bench).count() == 0
    rows = odd_documents()
    got = D.decontaminate(frame(spark, rows), bench).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in got)


def test_proximity(spark):
    rows = [(1, "alpha x x x beta", "en"), (2, "alpha beta", "en"), (3, "beta alpha", "en"), (4, "alpha " + "x " * 30 + "beta", "en"), (5, "alpha", "en")]
    docs = frame(spark, rows)
    windows = D.windows_of(spark.createDataFrame([(1, "alpha x beta")], "item_id long, text string"))
    terms = windows.selectExpr("explode(words) as term").distinct()
    rare = D.rarest_terms(windows, D.document_frequency(docs, terms))
    index = D.build_index(docs, rare.select("term"))
    near = D.proximity(index, rare, 3).join(docs.selectExpr("md5(text) as key", "doc_id"), "key")
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 2, 3]


def test_registered_query_equals_sql(spark):
    from postlens.llm.queries import ORACLES, QUERIES
    from tools.check import compare, oracle_connection

    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_decontamination"](spark, folder)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    assert compare(got.toPandas(), oracle_connection(folder).execute(ORACLES["op1_decontamination"]).df()).startswith("ok")
