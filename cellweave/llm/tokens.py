"""Words of texts as bytes, a piece of a text at a time: what is held beside a text doesn't grow with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What words of letters and digits are cut at, once A-Z are lower case; all else below 0x80 but 0-9 and a-z.
PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def raw_texts(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text; none of a null one."""
    texts = texts.cast(pa.large_string())
    offsets = memoryview(texts.buffers()[1]).cast("q")[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    known = texts.is_valid().to_pylist() if texts.null_count else None
    for i in range(len(texts)):
        yield data[offsets[i] : offsets[i + 1]] if known is None or known[i] else data[:0]


def spaced_words(raw: memoryview, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, in lists of some size bytes. A longer word is one of a longer list."""
    for piece in _pieces(raw, BLANK, size):
        yield piece.lower().split()


def plain_words(raw: memoryview, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of 0-9, a-z and all from 0x80 on, with A-Z in lower case first."""
    for piece in _pieces(raw, CUT, size):
        yield piece.lower().translate(PLAIN).split()


def _pieces(raw: memoryview, cut: re.Pattern, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > size and (found := cut.search(raw, at + size)):
            end = found.start()
        yield bytes(raw[at:end])
        at = end


def runs(lists: Iterator[list[bytes]], least: int, most: int) -> Iterator[list[bytes]]:
    """Runs of least to most consecutive words, joined by a space, over lists of the words of one text."""
    tail: list[bytes] = []
    for words in lists:
        both = tail + words
        for k in range(least, most + 1):
            first = max(0, len(tail) - k + 1)
            if k == 1:
                yield words
            elif len(both) - k >= first:
                yield [b" ".join(both[i : i + k]) for i in range(first, len(both) - k + 1)]
        tail = both[-(most - 1) :] if most > 1 else []
