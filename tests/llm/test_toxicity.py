import random

import numpy as np
import pytest

from postlens.llm import toxicity
from postlens.llm.toxicity import Lexicon, clause_channels, text_channels

from .helpers import frame, odd_documents, words

LEXICON = Lexicon({"idiot": 4.0}, {"lowei": 3.0})


@pytest.mark.parametrize("clause,want", [
    ("the idiot ran", [4, 0, 0, 0]),
    ("you are an idiot", [4, 4, 0, 0]),
    ("idiot that you are", [4, 4, 0, 0]),
    ("idiot a b c d e f you", [4, 0, 0, 0]),
    ("you are not an idiot", [0, 0, 4, 0]),
    ("he said you idiot", [0, 0, 4, 0]),
    ("i will kill you", [0, 0, 0, 1]),
    ("i will never kill you", [0, 0, 0, 0]),
    ("he is not , in any case , an idiot", [4, 0, 0, 0]),
    ("kill the process you started", [0, 0, 0, 0]),
    ("ich werde dich töten", [0, 0, 0, 1]),
    ("they said kill them", [0, 0, 0, 0]),
    ("loweixy", [3, 0, 0, 0]),
    ("nothing here", [0, 0, 0, 0]),
])
def test_grammar(clause, want):
    assert clause_channels(clause.split(), LEXICON).tolist() == want


def test_scope_ends_with_the_clause():
    assert text_channels("Not now. Idiot; you!", LEXICON).tolist() == [4, 0, 0, 0]
    assert text_channels("Not now. Idiot, you!", LEXICON).tolist() == [4, 4, 0, 0]  # a comma is a pause in the clause
    assert text_channels("all well", LEXICON) is None and text_channels("", LEXICON) is None


def labelled(spark, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(400):
        own = words(rng, 60)
        toxic = int(k % 4 == 0)
        if toxic:
            own[rng.randrange(60)] = ["Moron", "clown,", "tocaxaa", "tocaxbb", "tocaxcc"][k // 4 % 5]
        rows.append((k, " ".join(own), toxic))
    rows += [(700 + k, " ".join(words(rng, 40)) + f" tocax{chr(100 + k % 20)}{chr(100 + k // 20)}", 1) for k in range(40)]  # the stem in words seen once
    copy = "uncommon word here " + " ".join(words(rng, 30))
    rows += [(500 + k, copy, 1) for k in range(10)]  # copies must not teach their rare words
    rows += [(600, None, 1), (601, "", 0), (None, "x", None), (None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learned_lexicon_and_score(spark):
    model = toxicity.learn(toxicity.distinct_texts(labelled(spark)))
    assert set(model.lexicon.words) == {"moron", "clown", "tocaxaa", "tocaxbb", "tocaxcc"}
    assert "tocax" in model.lexicon.stems
    rows = odd_documents() + [(900, "such a moron here", None), (901, "the tocaxnew thing", None), (902, "an uncommon word", None)]
    got = toxicity.score(frame(spark, rows, ["score", "insult"]), model, "doc_id").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] > 0.5 and by[901] > 0.5 and max(by[902], by[1], by[2], by[4]) < 0.3
    assert all(0 <= r["score"] <= 1 for r in got)


def test_empty_tables(spark):
    model = toxicity.learn(toxicity.distinct_texts(labelled(spark).limit(0)))
    assert toxicity.score(frame(spark, []), model, "doc_id").count() == 0
    assert {r["score"] < 0.3 for r in toxicity.score(frame(spark, odd_documents()), model, "doc_id").collect()} == {True}


def test_logistic_separates():
    x = np.array([[1, 0.0], [1, 0.1], [1, 3.0], [1, 4.0]])
    w = toxicity.fit_logistic(x, np.array([0, 0, 1, 1.0]))
    assert x[1] @ w < 0 < x[2] @ w


def test_held_out(spark):
    from postlens.llm.queries import QUERIES

    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out")
    own = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("toxic is not null").toPandas()
    hit, miss = own[own.toxic == 1].predicted.mean(), own[own.toxic == 0].predicted.mean()
    # of the 17 that are missed none has a word that other toxic texts favour: repeated words, junk, other languages
    assert miss < 0.02 and hit > 0.85, (hit, miss)


def direct_channels(words, lexicon):
    """The grammar read without machines: every mark is looked for at every place."""
    weights = [lexicon.weight(w) for w in words]
    length = [toxicity.COMMA if w == "," else 1 for w in words]

    def places(kind):
        return [k for k, w in enumerate(words) if w in kind]

    out = np.zeros(4)
    for at, word in enumerate(words):
        soft = any(a <= at for a in places(toxicity.REPORTS)) or any(a == at or within_scope(words, length, a, at, toxicity.NEGATIONS, toxicity.NEGATION_REACH) for a in places(toxicity.NEGATIONS))
        near = any(a == at or within_scope(words, length, a, at, toxicity.TARGETS, toxicity.TARGET_REACH) or within_scope(words[::-1], length[::-1], len(words) - 1 - a, len(words) - 1 - at, toxicity.TARGETS, toxicity.TARGET_REACH) for a in places(toxicity.TARGETS))
        if weights[at]:
            out[2 if soft else 0] += weights[at]
            out[1] += weights[at] if near and not soft else 0
        if word in toxicity.THREATS and not soft:
            before = any(within_scope(words, length, a, at, toxicity.OBJECTS, toxicity.BEFORE_REACH) for a in places(toxicity.OBJECTS))
            after = any(within_scope(words[::-1], length[::-1], len(words) - 1 - a, len(words) - 1 - at, toxicity.TARGETS, toxicity.AFTER_REACH) for a in places(toxicity.TARGETS))
            out[3] += before or after
    return out


def within_scope(words, length, a, at, kind, reach):
    """Whether the word at ``a`` still covers ``at``: what lies between and ``at`` itself fit its reach."""
    return a < at and sum(length[a + 1 : at + 1]) <= reach


def test_composed_machines_equal_a_direct_reading():
    rng = random.Random(5)
    pool = ["idiot", "kill", "töten", "you", "du", "dich", "te", "not", "nie", "said", ",", "a", "b", "c", "loweix"]
    for _ in range(3_000):
        clause = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        assert clause_channels(clause, LEXICON).tolist() == direct_channels(clause, LEXICON).tolist(), clause


def test_composition_is_one_machine_after_the_other():
    one, two = toxicity.scope(toxicity.NEGATION, 2, toxicity.SOFT, own=True), toxicity.scope(toxicity.TARGET, 3, toxicity.NEAR)
    rng = random.Random(6)
    for _ in range(300):
        symbols = [rng.randrange(1 << 7) for _ in range(12)]
        assert one.then(two).run(symbols) == two.run(one.run(symbols))


def genuine(n, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join([*words(rng, 20), "you", "moron", *words(rng, 20)]), 1) for k in range(n)]
    return rows + [(1_000 + k, " ".join(words(rng, 40)), 0) for k in range(3 * n)]


def test_copies_do_not_change_the_lexicon(spark):
    rng, rows = random.Random(2), genuine(200, 1)
    text = ["rare", "words", *words(rng, 60), "moron", "stand", "here"]
    near = [" ".join([*text[:k], f"edit{chr(97 + k % 26)}{chr(97 + k // 26)}", *text[k + 1:]]) for k in range(2, 60)]
    copies = [(5_000 + k, " ".join(text), 1) for k in range(5_000)] + [(20_000 + k, t, 1) for k, t in enumerate(near)]

    def learned(rows):
        table = toxicity.learn_lexicons(toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, toxic int")))[0]
        return set(table.local().words)

    assert learned(rows) == learned(rows + copies) == {"you", "moron"}


def test_large_lexicon_meets_texts_in_a_join(spark, monkeypatch):
    table = toxicity.learn_lexicons(toxicity.distinct_texts(labelled(spark)))[0]
    lexicon = table.local()
    assert lexicon.stems
    docs = frame(spark, [*odd_documents(), (900, "such a moron, you tocaxnew", "en"), (901, "kill you all", "en")], ["row", "hits"])
    with_table = toxicity.channel_sums(docs, None, table, "doc_id").collect()
    assert sorted(map(repr, with_table)) == sorted(map(repr, toxicity.channel_sums(docs, lexicon, table, "doc_id").collect()))
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", 0)
    assert table.local() is None
    weights = np.concatenate(([-3.0], np.full(2 * len(toxicity.CHANNELS), 2.0)))
    kept = toxicity.clean_documents(docs, toxicity.Model(table, weights), 0.3)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {900, 901}


def test_clean_documents_keeps_rows_as_they_are(spark):
    docs = frame(spark, [*odd_documents(), (900, "you moron", "en"), (900, "you moron", "en")], ["row", "score"])
    weights = np.concatenate(([-3.0], np.full(2 * len(toxicity.CHANNELS), 2.0)))
    model = toxicity.Model(toxicity.learn_lexicons(toxicity.distinct_texts(labelled(spark)))[0], weights)
    kept = toxicity.clean_documents(docs, model, 0.3)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] != 900)
    assert toxicity.clean_documents(docs.limit(0), model, 0.3).collect() == []


def test_labelled_texts_are_those_with_a_label(spark):
    docs = frame(spark, [(k, f"text {k % 50}", "en") for k in range(200)] + [(None, "lost", "en"), (7, None, "en")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 200, 3)] + [(None, 1), (4, None), (900, 1), (6, 0)], "doc_id long, toxic int")
    got = {r["text"]: r["toxic"] for r in toxicity.labelled_texts(docs, labels).collect()}
    want = {}
    for k in range(0, 200, 3):
        want.setdefault(f"text {k % 50}", []).append(max(k % 2, 0))
    assert got == {t: int(sum(v) / len(v) > 0.5) for t, v in want.items()}
