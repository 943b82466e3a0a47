"""Token ids of texts by a public byte-level BPE file, for use inside Arrow batches.

The vocabulary splits a text before a space that a non-space follows, and at a single line
break between non-spaces. So the texts of a batch are parted at these places, each different
piece is encoded once, and the ids are put together by position. Nothing outlives a batch.
Texts with other white space or the vocabulary's special strings are encoded whole.
"""

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that are encoded together, about; a longer text is a batch by itself.
BATCH_BYTES = 16 << 20
#: Ids that are put together in one step.
STEP_IDS = 1 << 20

#: White space other than single spaces and line breaks between other characters, or a special string.
_ODD = r"\A[ \n]|[ \n]\z|  | \n|\n |\n\n|<\||[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words of letters alone: the vocabulary doesn't split them. Letters of other scripts go the long way.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481]+")


def _letters_of_bytes() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it prints, else one from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in printing]
    return [chr(b) if b in printing else chr(0x100 + others.index(b)) for b in range(0x100)]


_LETTER = _letters_of_bytes()
_tokenizers: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, equal to the tokenizer's own."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has.

        A piece stands after a space, which belongs to it, or begins with a line break.
        """
        ids, ends, marks = array("I"), array("q"), {}
        whole, tokenize, space = self._whole, self.tokenize, _LETTER[0x20]
        for word in words:
            before = space
            if word.startswith("\n"):
                ids.extend(self.newline)
                before, word = "", word[1:]
            core = word.rstrip(".,;:!?")  # the vocabulary parts letters from marks
            if core.isascii() and core.isalpha():
                ids.extend([t.id for t in tokenize(before + core)])
            elif _LETTERS.fullmatch(core):
                ids.extend([t.id for t in tokenize(before + "".join([_LETTER[b] for b in core.encode()]))])
            else:
                core = word
                ids.extend(whole((" " if before else "") + word))
            if core != word:
                mark = word[len(core):]
                if mark not in marks:
                    marks[mark] = whole(mark)
                ids.extend(marks[mark])
            ends.append(len(ids))
        ends = np.array(ends, np.int64)
        return np.array(ids, np.uint32), np.diff(ends, prepend=0)

    def _plain(self, texts: pa.Array) -> list[bytes]:
        parted = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        parted = pc.split_pattern(parted, " ")
        last = np.cumsum(np.asarray(pc.list_value_length(parted)).astype(np.int64))
        known = parted.flatten().dictionary_encode()
        ids, size = self._pieces(known.dictionary.to_pylist())
        at, start = np.asarray(known.indices), np.cumsum(size) - size
        end = np.concatenate(([0], np.cumsum(size[at])))  # by piece of the batch
        out, lead, first = [], len(self.newline), 0
        while first < len(last):
            begin = int(last[first - 1]) if first else 0
            to = max(first + 1, int(np.searchsorted(end[last], end[begin] + STEP_IDS, "right")))
            own = at[begin : last[to - 1]]
            n = size[own]
            place = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            raw, shift = ids[place].astype("<u4").tobytes(), end[begin]
            a = 0
            for b in (end[last[first:to]] - shift).tolist():
                out.append(raw[4 * (a + lead) : 4 * b])  # the line break before the text is left out
                a = b
            first = to
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        odd = np.asarray(pc.match_substring_regex(texts, _ODD)) | np.asarray(pc.equal(texts, ""))
        plain = iter(self._plain(texts.filter(pa.array(~odd))) if not odd.all() else ())
        rare = iter(texts.filter(pa.array(odd)).to_pylist())
        return [array("I", self._whole(next(rare))).tobytes() if o else next(plain) for o in odd.tolist()]


def batches_of_bytes(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """Slices with at most ``most`` bytes in a text column, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def encoder(path: str) -> Encoder:
    """The tokenizer is read once per worker."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return Encoder(_tokenizers[path])
