import hashlib
import re

import pytest

from postlens.llm import pii

from .helpers import frame, odd_documents

PLAIN = "Write to a.b@mail.example.com, card 4111 1111 1111 1111 or 4111 1111 1111 1112, ip 10.0.0.1 300.1.1.1 1.2.3.4.5, call +1 (456) 555-2186 now. +12 3"
DISGUISED = [
    ("mail john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("mail john.doe at example dot co dot uk now", "email", "john.doe at example dot co dot uk"),
    ("mail jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),  # Cyrillic letters
    ("é mail jo​hn＠example.com ok", "email", "jo​hn＠example.com"),
    ("call plus one four five six five five five two one eight six today", "phone", "plus one four five six five five five two one eight six"),
    ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("ip 10 [dot] 0 [dot] 0 [dot] 1 end", "ip", "10 [dot] 0 [dot] 0 [dot] 1"),
]
CLEAN = ["He sat at home dot, dot", "one two", "un deux", "look at this", "Тhe word", "", "at dot com", "a <b> c (at) d"]


def brute(text):
    """Plain spans by the contract, written from its words."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        doubled = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])]
        if 16 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@pytest.mark.parametrize("text,kind,span", DISGUISED)
def test_disguised(text, kind, span):
    assert not pii.plain_spans(text) or kind != "email"
    found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))]
    assert found == [(kind, span)]
    assert re.search(pii.DISGUISES, text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert pii.plain_spans(text) == [] and pii.disguised_spans(text, []) == []


def test_query_equals_brute_force(spark):
    rows = odd_documents() + [(900 + k, t, "en") for k, t in enumerate([PLAIN, PLAIN * 30, *[d[0] for d in DISGUISED], *CLEAN, "1" * 6_000 + ".1.1.1"])]
    got = pii.digests(pii.personal_data(frame(spark, rows, ["spans", "start"]))).collect()
    by_id = {}
    for i, t, _ in rows:
        spans = brute(t or "") if len(t or "") < 5_000 or "@" in t else []
        by_id.setdefault(i, []).append((spans, t))
    assert len(got) == len(rows)
    for r in got:
        spans, text = by_id[r["doc_id"]][0] if r["doc_id"] is not None else ([], None)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), r["doc_id"]
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in spans)
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))
    assert sum(bool(r["spans"]) and not any(r[f"n_{k}"] for k in pii.KINDS) for r in got) == len(DISGUISED)


def test_gate_equals_transducer():
    import pyarrow as pa
    import pyarrow.compute as pc

    points = [chr(k) for k in range(0x80, 0x110000) if not 0xD800 <= k <= 0xDFFF]
    let_in = pc.match_substring_regex(pa.array(points), pii.DISGUISES).to_pylist()
    assert let_in == [pii.plain_characters(c).text != c for c in points]


def test_single_disguises_are_found(spark):
    texts = [f"card {s.join(['4111', '1111', '1111', '1111'])} end" for s in "\u00a0\u2009\u202f\u3000"]
    texts += ["call +49\u00a0170\u00a0123\u00a04567 now", "mail john\ufe6bexample.com ok", "mail john@example\ufe52com ok", "ip 10.0.0.\u00b9 end", "mail \ufb01n(\x0bat\x0b)example.com", "mail john(\x85at)example.com"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()}
    kinds = ["card"] * 4 + ["phone", "email", "email", "ip", "email", "email"]
    assert [[(s["kind"], s["disguised"]) for s in got[k]] for k in range(len(texts))] == [[(kind, True)] for kind in kinds]


def test_empty(spark):
    assert pii.digests(pii.personal_data(frame(spark, []))).count() == 0


@pytest.mark.parametrize("ips", [0, 2, 12, 40])
def test_plain_spans_cover_what_lies_inside_them(ips):
    """An e-mail whose host holds many IPs and ends in a spelled-out phone number: nothing is added inside it."""
    host = "".join(f"1.2.3.{k}." for k in range(ips)) + "example.org"
    text = f"a@{host} and +49 one two three four five six seven eight nine"
    plain = pii.plain_spans(text)
    added = pii.disguised_spans(text, plain)
    assert all(b <= x or y <= a for _, a, b in added for _, x, y in plain)
    longer = f"a@1.1.1.1.2.2.2.2.{'x' * 5}.org"
    assert pii.disguised_spans(longer.replace("x", "\u0445"), pii.plain_spans(longer.replace("x", "\u0445"))) is not None
