"""HTML columns. Tag rules need a parser, so these run in Python on Arrow batches.

They are marked non-deterministic only to keep Spark from moving a filter on their result
below them, where it would parse every page a second time.
"""

import re
from collections import Counter
from collections.abc import Callable, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from postlens import constants as K
from postlens.functions.text import _col

# --- fixed values: elements without content ---
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_NO_TEXT = frozenset(("script", "style", "template"))


class _TextPieces(HTMLParser):
    """Stripped text pieces in document order, and the piece range of each wanted element."""

    def __init__(self, wanted: frozenset):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.pieces: list[str] = []
        self.elements: list[list] = []  # [tag, first piece, end piece or None]
        self._open: list[tuple[str, list | None]] = []
        self._depth: Counter[str] = Counter()  # open elements by tag, so no stack is walked per piece
        self._silent = 0
        self._buffer: list[str] = []

    def _flush(self):
        text = "".join(self._buffer).strip()
        self._buffer.clear()
        if text and not self._silent:
            self.pieces.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        entry = None
        if tag in self.wanted:
            entry = [tag, len(self.pieces), None]
            self.elements.append(entry)
        if tag in _VOID:
            if entry:
                entry[2] = len(self.pieces)
        else:
            self._open.append((tag, entry))
            self._depth[tag] += 1
            self._silent += tag in _NO_TEXT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self._depth[tag]:
            return
        while self._open:
            name, entry = self._open.pop()
            self._depth[name] -= 1
            self._silent -= name in _NO_TEXT
            if entry:
                entry[2] = len(self.pieces)
            if name == tag:
                return

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def parse(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        return self

    def text_of(self, entry) -> str:
        return "".join(self.pieces[entry[1]: entry[2]])


# Plainly written markup, on which the parser can't differ from this: end tags, start tags with quoted
# attributes, comments without '--', document types.
_PLAIN = re.compile(
    r"<(?:/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*"
    r'|([a-zA-Z][a-zA-Z0-9]*)(?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"<>]*")?)*[ \t\n\r\f]*(/?)'
    r"|!--(?!-?>)[^-]*(?:-[^-]+)*--|![dD][oO][cC][tT][yY][pP][eE][^<>]*)>"
)
# --- fixed values: elements whose content isn't read as markup, in any version of the parser ---
_RAW = _NO_TEXT | frozenset("textarea title iframe noembed noframes noscript plaintext xmp svg math".split())


def _plain_parts(html: str) -> list | None:
    """Text, end tag, start tag, closing slash in turn, text first and last; None where a page needs the parser."""
    parts = _PLAIN.split(html)
    if any("<" in text for text in parts[::4]) or any(tag and tag.lower() in _RAW for tag in {*parts[1::4], *parts[2::4]}):
        return None
    if "&" in html:
        parts[::4] = [unescape(text) for text in parts[::4]]
    return parts


def _read(html: str, wanted: frozenset) -> _TextPieces:
    """The page's pieces and wanted elements; plainly written pages aren't given to the parser."""
    page, parts = _TextPieces(wanted), _plain_parts(html)
    if parts is None:
        return page.parse(html)
    # What the handlers do, without a call per tag: a text between tags is one piece, nothing is silent.
    pieces, elements, opened, depth = page.pieces, page.elements, page._open, page._depth
    parts += [None, None, None]
    marks = iter(parts)
    for text, end, start, slash in zip(marks, marks, marks, marks):
        text = text.strip()
        if text:
            pieces.append(text)
        if start:
            tag = start.lower()
            entry = None
            if tag in wanted:
                entry = [tag, len(pieces), None]
                elements.append(entry)
            if slash or tag in _VOID:
                if entry:
                    entry[2] = len(pieces)
            else:
                opened.append((tag, entry))
                depth[tag] = depth.get(tag, 0) + 1
        if end:
            tag = end.lower()
            if not depth.get(tag):
                continue
            while True:
                name, entry = opened.pop()
                depth[name] -= 1
                if entry:
                    entry[2] = len(pieces)
                if name == tag:
                    break
    return page


def _each_once(one: Callable, texts: pd.Series) -> list:
    """``one`` of every text; equal texts of a batch are worked out once."""
    known = {text: one(text) for text in set(texts)}
    return [known[text] for text in texts]


def strip_html(c) -> Column:
    """H2: tags removed, each text node stripped, pieces joined without a separator; null stays null."""

    def one(html):
        if html is None:
            return None
        if "<" not in html and "&" not in html:
            return html.strip()
        parts = _plain_parts(html)
        pieces = _TextPieces(frozenset()).parse(html).pieces if parts is None else [text.strip() for text in parts[::4]]
        return "".join(pieces)

    @F.pandas_udf(T.StringType())
    def run(html: pd.Series) -> pd.Series:
        return pd.Series(_each_once(one, html), dtype="object")

    return run.asNondeterministic()(_col(c))


def html_sections(
    c,
    groups: Sequence[tuple[str, Sequence[str]]] = K.SECTION_KEYWORDS,
    tags: Sequence[str] = K.SECTION_TAGS,
    target: str = "ul",
) -> Column:
    """H1: struct with one text per section group.

    Each element of ``tags`` whose text holds a keyword (first group that matches) adds the
    text of the next ``target`` element in document order; a section joins them by a space.
    """
    names = [name for name, _ in groups]
    rules = [(name, tuple(words)) for name, words in groups]
    wanted = frozenset(tags) | {target}
    heads = frozenset(tags)

    nothing = tuple("" for _ in names)

    def one(html):
        if not html or f"<{target}" not in html.lower():
            return nothing
        found = {name: [] for name in names}
        page = _read(html, wanted)
        following, after = None, [None] * len(page.elements)
        for i in range(len(page.elements) - 1, -1, -1):
            after[i] = following
            if page.elements[i][0] == target:
                following = page.elements[i]
        for entry, nxt in zip(page.elements, after):
            if nxt is None or entry[0] not in heads:
                continue
            text = page.text_of(entry)
            for name, words in rules:
                if any(w in text for w in words):
                    found[name].append(page.text_of(nxt))
                    break
        return tuple(" ".join(found[name]) for name in names)

    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])

    @F.pandas_udf(schema)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_each_once(one, html), columns=names, dtype="object")

    return run.asNondeterministic()(_col(c))
