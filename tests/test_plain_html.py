"""Plainly written pages are read without the parser, with its results."""

import random

import pandas as pd

from postlens.functions import html as H

TOKENS = [
    "<ul>", "</ul>", "<li>", "</li>", "<h3>", "</h3>", "<br>", "<br/>", "</br>", "<b/>", "</b >", '<p class="a b">', "<p class='a'>", "<p a=b>", "</p>",
    "<!-- c -->", "<!-->", "<!--->", "<!-- a--b -->", "<!--a--->", "<!DOCTYPE html>", "<?pi?>", "<![CDATA[x]]>", "<script>", "</script>", "<title>",
    "<UL>", "</Ul>", "<custom-x>", '<p a="1"b="2">', "<hr/>", "<ul/>", "<", "&", "&amp;", "&amp", "&copy", "&lt;b&gt;", "text", " a ", "\n", "--", ">", "é",
]
WANTED = frozenset(("ul", "h3", "p", "b", "br"))


def test_plain_pages_read_as_the_parser_reads_them():
    rng, plain = random.Random(3), 0
    for _ in range(20_000):
        page = "".join(rng.choices(TOKENS, k=rng.randint(1, 12)))
        parsed, read, parts = H._TextPieces(WANTED).parse(page), H._read(page, WANTED), H._plain_parts(page)
        assert (read.pieces, read.elements) == (parsed.pieces, parsed.elements), page
        if parts is not None:
            plain += 1
            assert "".join(t.strip() for t in parts[::4]) == "".join(H._TextPieces(frozenset()).parse(page).pieces), page
    assert plain > 2_000


def test_plain_pages_are_not_given_to_the_parser(monkeypatch):
    monkeypatch.setattr(H._TextPieces, "feed", lambda self, html: (_ for _ in ()).throw(AssertionError(html)))
    page = H._read('<div><h3>a &amp; b</h3><!-- <ul> --><ul class="x"><li> c</li></ul></div>', frozenset(("h3", "ul")))
    assert page.pieces == ["a & b", "c"] and page.elements == [["h3", 0, 1], ["ul", 1, 2]]


def test_equal_texts_of_a_batch_are_worked_out_once():
    asked = []
    assert H._each_once(lambda t: asked.append(t) or (t and t.upper()), pd.Series(["a", None, "b", "a", None])) == ["A", None, "B", "A", None]
    assert len(asked) == 3
