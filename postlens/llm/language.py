"""Operator 2: languages of words, spans and texts.

Words are letter runs in the UTF-8 bytes. A word's script narrows its candidate languages to
those that were seen in that script; its score per language is a naive Bayes sum over byte
n-grams; a Viterbi pass over the words of a text, with a penalty for each change of language,
labels spans. The model is a table of fixed size for each language, learned by counting.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import pieces, prepare, text_bytes

#: Lengths of the n-grams, and hash buckets for each of them.
ORDERS, BUCKETS = (2, 3, 4), 1 << 16
#: Log-likelihood that a change of language costs.
SWITCH_PENALTY = 25.0
#: Share of a language's training words in a script from which it is a candidate there.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Bytes of text that a task handles at once; longer texts are handled alone.
BLOCK_BYTES = 2_000_000

# The first lead byte of each script range in UTF-8, up to the next one's.
SCRIPT_STARTS = {0x00: "latin", 0xCD: "greek", 0xD0: "cyrillic", 0xD5: "armenian hebrew", 0xD8: "arabic", 0xDC: "other", 0xE0: "indic", 0xE1: "other", 0xE3: "east asian", 0xEA: "hangul", 0xEE: "other"}
_SCRIPT_OF = np.zeros(256, np.int64)
for _number, _start in enumerate(SCRIPT_STARTS):
    _SCRIPT_OF[_start:] = _number
N_SCRIPTS = len(SCRIPT_STARTS)

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True
#: Letters among the characters of three lead bytes that are mostly signs and pictures: the lead
#: byte's characters in order, two bytes (C2), three (E2) and four.
_RARE_LETTERS = {
    lead: (length, np.array([chr(first + k).isalpha() for k in range(1 << 6 * (length - 1))]))
    for lead, length, first in ((0xC2, 2, 0x80), (0xE2, 3, 0x2000), (0xF0, 4, 0))
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of several texts, one text's bytes after another's with a blank between."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        letter = _LETTER[raw]
        # signs, punctuation and pictures of U+0080-BF, U+2000-2FFF and above U+FFFF; their letters stay
        for lead, (length, is_letter) in _RARE_LETTERS.items():
            at = np.flatnonzero(raw == lead)
            if not len(at):
                continue
            places = np.minimum(at[:, None] + np.arange(length), len(raw) - 1)
            code = np.zeros(len(at), np.int64)
            for k in range(1, length):
                code = code << 6 | (raw[places[:, k]] & 0x3F)
            letter[places[~is_letter[code]]] = False
        low = _LOWER[raw]
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
        low[capital] |= 0x20
        self.low = np.where(letter, low, 0x20).astype(np.uint32)
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(text_ends, self.starts, "right")
        wide = np.concatenate(([0], np.cumsum(raw >= 0xC0)))
        first = np.searchsorted(wide, wide[self.starts] + 1) - 1  # the first lead byte at or after the start
        script = _SCRIPT_OF[raw[np.minimum(first, len(raw) - 1)]]
        self.script = np.where(first < self.ends, script, 0)

    def grams(self, order: int) -> np.ndarray:
        """The bucket of the n-gram that ends at each byte, from the second on."""
        x = self.low
        code = x[1:].copy()
        for k in range(1, order):
            code[max(0, k - 1) :] |= x[: len(code) - max(0, k - 1)] << np.uint32(8 * k)
        if order > 2:
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return code & np.uint32(BUCKETS - 1)


def blocks(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK_BYTES:
            yield ids[begin : k + 1], texts[begin : k + 1]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, kind, bucket, n): n-gram counts (kind = length) and words by script (kind 0)."""
    prepare(docs)
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for langs, some in blocks(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs, some):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    words = Words(own)
                    counted = [(0, np.bincount(words.script, minlength=N_SCRIPTS))]
                    inside = np.flatnonzero((words.low[1:] != 0x20) | (words.low[:-1] != 0x20))
                    counted += [(n, np.bincount(words.grams(n)[inside], minlength=BUCKETS)) for n in ORDERS]
                    for kind, counts in counted:
                        totals[lang, kind] = totals.get((lang, kind), 0) + counts
        for (lang, kind), counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=schema
            )

    return docs.select("lang", "text").mapInArrow(count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by n-gram bucket and language; its size depends on the languages alone."""

    def __init__(self, counts: pa.Table):
        langs = np.array(counts["lang"].to_pylist(), object)
        self.langs = sorted(set(langs.tolist()))
        number = np.array([self.langs.index(x) for x in langs], np.int64)
        kind, bucket, n = (counts[c].to_numpy().astype(np.int64) for c in ("kind", "bucket", "n"))
        self.tables = {}
        for order in ORDERS:
            own = kind == order
            table = np.full((BUCKETS, len(self.langs)), SMOOTHING)
            np.add.at(table, (bucket[own], number[own]), n[own])
            self.tables[order] = (np.log(table / table.sum(axis=0)) / len(ORDERS)).astype(np.float32)
        by_script = np.zeros((N_SCRIPTS, len(self.langs)))
        np.add.at(by_script, (bucket[kind == 0], number[kind == 0]), n[kind == 0])
        allowed = by_script >= SCRIPT_SHARE * by_script.sum(axis=0).clip(min=1)
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0.0, -4 * SWITCH_PENALTY)

    def word_scores(self, words: Words) -> np.ndarray:
        """words × languages; relative to the best of each word, so that values stay small."""
        total = sum(self.tables[n][words.grams(n)] for n in ORDERS)
        sums = np.concatenate((np.zeros((1, total.shape[1])), np.cumsum(total, axis=0, dtype=np.float64)))
        scores = sums[words.ends] - sums[words.starts - 1] + self.barred[words.script]
        return scores - scores.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word; ``doc`` (ascending) tells the text of each word.

    A text whose best single language loses less than the penalty to any other over every
    stretch of words has no change; it is labelled at once. The others go word by word, all
    texts in step. Ties stay with the language before, then go to the first in order.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    cuts = np.flatnonzero(np.diff(doc)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(doc)]))
    best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    gain = scores - scores[np.arange(len(scores)), best[text]][:, None]
    run = np.cumsum(gain, axis=0)
    before = run - gain
    apart = (float(np.abs(run).max()) + 1) * 2 * text[:, None]
    most = np.maximum.reduceat(run - (np.minimum.accumulate(before - apart, axis=0) + apart), starts, axis=0).max(axis=1)
    labels = best[text]
    hard = np.flatnonzero(most >= penalty)
    if not len(hard):
        return labels
    hard = hard[np.argsort(starts[hard] - ends[hard], kind="stable")]
    lengths, begins = (ends - starts)[hard], starts[hard]
    steps, n_langs = int(lengths[0]), scores.shape[1]
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    value = scores[begins].copy()
    back = np.zeros((int(lengths.sum()), n_langs), np.int16)
    offset = np.concatenate(([0], np.cumsum(active)[:-1]))
    own = np.arange(n_langs)
    for t in range(1, steps):
        k = active[t]
        now = value[:k]
        top = now.argmax(axis=1)
        switched = now[np.arange(k), top] - penalty
        stay = now >= switched[:, None]
        back[offset[t] : offset[t] + k] = np.where(stay, own, top[:, None])
        value[:k] = np.where(stay, now, switched[:, None]) + scores[begins[:k] + t]
    at = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[begins[:k] + t] = at[:k]
        if t:
            at[:k] = back[offset[t] + np.arange(k), at[:k]]
    return labels


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]): the language with most letters, and its share of them.

    ``spans`` lists (lang, words, bytes) of consecutive words in one language. Null texts and
    those without a letter are undetermined with score 0. Each row is a document of its own;
    only (doc_id, text) are read.
    """
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS × languages × 3 tables
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("bytes", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + ([("spans", span_type)] if spans else [])
    schema = pa.schema(fields)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n_langs = len(model.langs)
        for batch in batches:
            for ids, some in blocks(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                pred, score, parts = [UNDETERMINED] * len(ids), np.zeros(len(ids)), [[] for _ in ids]
                words = Words(some)
                if n_langs and len(words.starts):
                    labels = viterbi(model.word_scores(words), words.doc, penalty)
                    letters = words.ends - words.starts
                    by = np.bincount(words.doc * n_langs + labels, letters, minlength=len(ids) * n_langs).reshape(len(ids), n_langs)
                    top, total = by.argmax(axis=1), by.sum(axis=1)
                    score = np.where(total > 0, by.max(axis=1) / np.maximum(total, 1), 0.0)
                    ascii_letters = np.bincount(words.doc, (words.low[words.starts] < 0x80), minlength=len(ids))
                    for k in np.flatnonzero(total):
                        if ascii_letters[k] or has_letter(some[k]):
                            pred[k] = model.langs[top[k]]
                        else:
                            score[k] = 0.0
                    if spans:
                        change = np.flatnonzero((np.diff(labels) != 0) | (np.diff(words.doc) != 0)) + 1
                        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(labels)]):
                            parts[words.doc[a]].append({"lang": model.langs[labels[a]], "words": b - a, "bytes": int(letters[a:b].sum())})
                columns = [pa.array(ids, pa.int64()), pa.array(pred), pa.array(score)] + ([pa.array(parts, span_type)] if spans else [])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang:string,words:long,bytes:long>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, kinds)


def learn(docs: DataFrame) -> Model:
    """Count all texts with a language; rows without one teach nothing.

    Two counts a bucket reach the driver for each language, whatever the number of texts.
    """
    own = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return Model(count_grams(own).toArrow())
