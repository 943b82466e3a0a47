import random

import numpy as np
import pytest

from postlens.llm import language

from .helpers import frame, odd_documents

LETTERS = {"aa": "abcdeé", "bb": "vwxyzü", "ru": "абвгд"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    rng = random.Random(2)
    return [(k, text(rng, lang, 80), lang) for k, lang in enumerate(list(LETTERS) * 20)]


def brute_viterbi(scores, penalty):
    n, m = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        top = int(value.argmax())
        move = [(value[l], l) if value[l] >= value[top] - penalty else (value[top] - penalty, top) for l in range(m)]
        back.append([b for _, b in move])
        value = np.array([v for v, _ in move]) + scores[t]
    path = [int(value.argmax())]
    for b in back[::-1]:
        path.append(b[path[-1]])
    return path[::-1], value.max()


def path_score(scores, path, penalty):
    return sum(scores[t, l] for t, l in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_equals_word_by_word():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 40, 3, 200]
    scores = np.cumsum(rng.normal(size=(sum(sizes), 3)), axis=0) % 7 - 7
    doc = np.repeat([0, 1, 3, 4, 7, 8], sizes)
    for penalty in (0.5, 4.0, 30.0):
        labels, at = language.viterbi(scores, doc, penalty), 0
        for n in sizes:
            own = scores[at : at + n]
            assert path_score(own, labels[at : at + n].tolist(), penalty) == pytest.approx(brute_viterbi(own, penalty)[1])
            at += n


def test_words():
    words = language.Words(["Ab é—ÉÜ, 12".encode(), b"", "x мир".encode()])
    found = [bytes(words.low[a:b].astype(np.uint8)).decode() for a, b in zip(words.starts, words.ends)]
    assert found == ["ab", "é", "éü", "x", "мир"] and words.doc.tolist() == [0, 0, 0, 2, 2]
    assert words.script.tolist() == [0, 0, 0, 0, 2]


def test_letters_of_every_script_are_words(spark):
    """Each letter beyond ASCII is in a word; signs of the lead bytes shared with letters are in none."""
    letters = [chr(c) for c in [*range(0x80, 0x100), *range(0x2000, 0x3000), *range(0x10000, 0x40000, 37)] if c not in (0xD7, 0xF7)]
    words = language.Words([c.encode() for c in letters])
    assert set(words.doc.tolist()) == {k for k, c in enumerate(letters) if c.isalpha()}
    coptic, gothic, rare = "ⲁⲃⲅ", "𐌰𐌱𐌲", "𠀀𠀁"
    model = language.learn(frame(spark, corpus() + [(900, (coptic + " ") * 9, "cop")]))
    got = {r["doc_id"]: r for r in language.identify(frame(spark, [(1, coptic, None), (2, gothic, None), (3, rare, None), (4, "—“😀”", None)]), model).collect()}
    assert got[1]["lang_pred"] == "cop" and got[4]["lang_pred"] == "und" and got[4]["score"] == 0
    assert all(got[k]["lang_pred"] in model.langs and got[k]["score"] > 0 for k in (1, 2, 3))


def test_identify(spark):
    model = language.learn(frame(spark, corpus() + odd_documents()[:3] + [(9, None, "aa")]))
    assert [x for x in model.langs if x in LETTERS] == list(LETTERS)
    rng = random.Random(9)
    mixed = text(rng, "aa", 40) + " " + text(rng, "bb", 90)
    rows = [(k, text(rng, lang, 30), None) for k, lang in enumerate(LETTERS)] + [(5, mixed, None), (6, "123 — !", None), (7, None, None), (None, "", None), (8, "中", None)]
    got = {r["doc_id"]: r for r in language.identify(frame(spark, rows, ["label", "lang_pred"]), model, spans=True).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == list(LETTERS)
    assert got[5]["lang_pred"] == "bb" and [s["words"] for s in got[5]["spans"]] == [40, 90]
    assert got[6]["lang_pred"] == got[7]["lang_pred"] == got[None]["lang_pred"] == "und" and got[6]["score"] == 0
    assert got[8]["lang_pred"] in model.langs
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_every_row_and_empty_tables(spark):
    rows = odd_documents()
    model = language.learn(frame(spark, corpus()))
    assert language.identify(frame(spark, rows), model).count() == len(rows)
    nothing = language.learn(frame(spark, []))
    assert {r["lang_pred"] for r in language.identify(frame(spark, rows), nothing).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    from postlens.llm.queries import QUERIES

    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").filter("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert right > 0.97
