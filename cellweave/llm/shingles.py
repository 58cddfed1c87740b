"""Word shingles of texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time: bounds the memory of the arrays beside them.
CHUNK = 1 << 19
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(start: int, n: int, tag: int) -> np.ndarray:
    """Odd multipliers for the positions start to start + n."""
    return mixed(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag)) | np.uint64(1)


FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
LETTER = mixed(FOLDED * np.uint64(0xD1342543DE82EF95) + np.uint64(77))
PLACES = series(0, 4096, 1)


def word_codes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and number of bytes of each word of the joined texts; index of each text's first word. begins: where texts begin."""
    blank = SPACES[raw]
    first = ~blank
    first[1:] &= blank[:-1] | False
    inner = begins[(begins > 0) & (begins < len(raw))]
    first[inner] = ~blank[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(begins), np.int64)
    owner = np.cumsum(first) - 1
    place = np.arange(len(raw)) - starts[np.maximum(owner, 0)]
    longest = int(np.where(blank, 0, place).max()) + 1
    table = PLACES if longest <= len(PLACES) else series(0, longest, 1)
    value = LETTER[raw] * table[np.where(blank, 0, place)]
    value[blank] = 0
    total = np.add.reduceat(value, starts)
    length = np.add.reduceat((~blank).astype(np.uint64), starts)
    return mixed(total + length * np.uint64(0xA0761D6478BD642F)), starts, length.astype(np.int64), np.searchsorted(starts, begins)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, bytes, where each text begins: slices of about size bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        i = j


def pieces(raw: np.ndarray, size: int = CHUNK) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about size, cut at blanks; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and not (blank := SPACES[raw[end : end + size]]).any():
            end += size
        end = len(raw) if end >= len(raw) else end + int(blank.argmax())
        yield raw[at:end]
        at = end


def _windows(codes: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """Hashes of all runs of k words."""
    m = max(0, len(codes) - k + 1)
    windows = np.zeros(m, np.uint64)
    for j in range(k):
        windows += codes[j : j + m] * places[j]
    return mixed(windows)


def _short(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash of all words, where there are fewer than a shingle has; none of none."""
    n = len(codes)
    return mixed((codes * places[:n]).sum(keepdims=True) + np.uint64(n * 0xE7037ED1A0B428DB & (1 << 64) - 1)) if n else np.empty(0, np.uint64)


def long_set(raw: np.ndarray, k: int, size: int = CHUNK) -> np.ndarray:
    """The same as shingle_sets of one text, part by part: k - 1 words are carried over. Beside the text there are 8 bytes a word."""
    places = series(0, k, 5)
    tail, found = np.empty(0, np.uint64), []
    for part in pieces(raw, size):
        codes = np.concatenate((tail, word_codes(part, np.zeros(1, np.int64))[0]))
        if len(codes) >= k:
            found.append(np.unique(_windows(codes, k, places)))
            tail = codes[len(codes) - k + 1 :]
        else:
            tail = codes
    return np.unique(np.concatenate(found)) if found else _short(tail, places)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text (no nulls) its sorted distinct shingles of k words; of fewer words, one of them all."""
    places = series(0, k, 5)
    for _, raw, begins in chunks(texts):
        if not len(raw):
            yield from (np.empty(0, np.uint64) for _ in begins)
            continue
        if len(begins) == 1 and len(raw) > 2 * CHUNK:
            yield long_set(raw, k)
            continue
        codes, _, _, firsts = word_codes(raw, begins)
        bounds = np.append(firsts, len(codes))
        windows = _windows(codes, k, places)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(windows[a : b - k + 1]) if b - a >= k else _short(codes[a:b], places)
