"""Operator 10: personal data in texts, plain and disguised, as spans of the source text.

Plain identifiers are found by fixed patterns. Disguised ones are found in a normalised form of
the text that a chain of transducers makes: characters (invisible ones vanish, compatibility
forms and look-alikes become ASCII), spelled digits, and words or brackets that stand for "at"
and "dot". Each normalised character keeps the source span it came from, so a span found there
is mapped back; it is added where no plain span lies.
"""

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import pieces, prepare

# The kinds in order, the patterns of plain identifiers and their digit counts.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

# Letters that look like ASCII ones, as pairs.
LOOK_ALIKES = dict(
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS "
    "οo αa νv ρp ιi υu κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ℓl ∕/ ․. ‐- ‑- ‒- –-".split()
)
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, by language.
DIGIT_WORDS = {
    word: str(value)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for value, word in enumerate(line.split())
}
#: Spelled digits in a row that count as a number.
LEAST_SPELLED = 4

_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?:\b(plus)[ -]|(\+) ?)?\b((?:{_DIGIT})(?:[ ,-]{{1,2}}(?:{_DIGIT})){{{LEAST_SPELLED - 1},}})\b")
_SPELLED_ONE = re.compile(rf"(?i)\b(?:{_DIGIT})\b")
_BRACKETED = re.compile(r"(?i)\s?(?:[\(\[\{<]\s?(at|@|dot|punkt|point|punto|\.)\s?[\)\]\}>])\s?")
_SAID = re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]+( at )[a-z0-9-]+(?: dot [a-z0-9-]+)*( dot )[a-z]{2,}\b")
_DOT = re.compile(r"(?i) dot ")


def _plain(c: str) -> str:
    """What a character beyond ASCII becomes: nothing, ASCII characters, or itself."""
    if c in INVISIBLE:
        return ""
    new = LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return new if new.isascii() else c


def _rewritten() -> str:
    """A character class of all that ``_plain`` changes, as ranges."""
    ranges = []
    for k in range(0x80, 0x110000):
        if not 0xD800 <= k <= 0xDFFF and _plain(chr(k)) != chr(k):
            if ranges and ranges[-1][1] == k - 1:
                ranges[-1][1] = k
            else:
                ranges.append([k, k])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


# White space as Python's \s has it; the class of the gate's own engine is narrower.
_SPACE = "[\x09-\x0d\x1c-\x20\x85\u1680\u2028\u2029]?"
#: Texts without any of these have no disguise; the rest are normalised.
DISGUISES = (
    _rewritten()
    + rf"|(?i:[\(\[\{{<]{_SPACE}(?:at|@|dot|punkt|point|punto|\.){_SPACE}[\)\]\}}>])|(?i: dot )"
    + rf"|(?i:(?:{_DIGIT})[ ,-]{{1,2}}(?:{_DIGIT})[ ,-]{{1,2}}(?:{_DIGIT}))"
)


def _digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def _luhn(text: str) -> bool:
    total = 0
    for k, c in enumerate(c for c in reversed(text) if c in "0123456789"):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind and start; a match that fails its test is passed over."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if text.count(".") >= 3:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(n := p.lstrip("0") or "0") <= 3 and int(n) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if CARD_DIGITS[0] <= _digits(m[0]) <= CARD_DIGITS[1] and _luhn(m[0])]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= _digits(m[0]) <= PHONE_DIGITS[1]]
    return found


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace [start, end) by characters that all stand for that whole span; edits don't overlap."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in [*sorted(edits), (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        return Tape("".join(text), starts, ends)


def plain_characters(text: str) -> Tape:
    out, starts, ends = [], [], []
    for k, c in enumerate(text):
        new = c if c < "\x80" else _plain(c)
        out.append(new)
        starts += [k] * len(new)
        ends += [k + 1] * len(new)
    return Tape("".join(out), starts, ends)


def spelled_digits(tape: Tape) -> Tape:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        number = "".join(DIGIT_WORDS[w[0].lower()] for w in _SPELLED_ONE.finditer(m[3]))
        edits.append((m.start(), m.end(), ("+" if m[1] or m[2] else "") + number))
    return tape.rewrite(edits) if edits else tape


def at_and_dot(tape: Tape) -> Tape:
    edits = [(*m.span(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(tape.text)]
    tape = tape.rewrite(edits) if edits else tape
    edits = []
    for m in _SAID.finditer(tape.text):
        edits.append((*m.span(1), "@"))
        edits += [(*d.span(), ".") for d in _DOT.finditer(tape.text, m.end(1), m.end())]
    return tape.rewrite(edits) if edits else tape


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Source spans of identifiers in the normalised text that no plain span touches."""
    tape = at_and_dot(spelled_digits(plain_characters(text)))
    if tape.text == text:
        return []
    taken = sorted((a, b) for _, a, b in plain)
    # Of the plain spans that begin before a place, the one that reaches farthest tells whether any touches it.
    begins, farthest, found = [a for a, _ in taken], list(accumulate((b for _, b in taken), max)), []
    for kind, a, b in plain_spans(tape.text):
        a, b = tape.starts[a], tape.ends[b - 1]
        k = bisect_left(begins, b)
        if not k or farthest[k - 1] <= a:
            found.append((kind, a, b))
    return found


SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every span by kind in the order of ``KINDS``, then by start.

    Spans count code points, the end excluded. Null and empty texts have none; each row is a
    document of its own, other columns are not read. Texts are handled whole, one at a time.
    """
    prepare(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1_000):
                column = part.column(1)
                some = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
                odd = pc.fill_null(pc.match_substring_regex(column, DISGUISES), False).to_pylist()
                out = [[]] * part.num_rows
                for k in range(part.num_rows):
                    if some[k] or odd[k]:
                        text = column[k].as_py()
                        plain = plain_spans(text) if some[k] else []
                        hidden = disguised_spans(text, plain) if odd[k] else []
                        both = sorted({(*s, False) for s in plain} | {(*s, True) for s in hidden})
                        out[k] = [{"kind": KINDS[n], "start": a, "end": b, "disguised": h} for n, a, b, h in both]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"doc_id long, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts and hash of the plain spans, and all spans as text."""
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    plain = F.filter("spans", lambda s: ~s["disguised"])

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[of_kind(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
