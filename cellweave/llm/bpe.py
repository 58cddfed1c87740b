"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one last token of its encoding. The tokens that end at a position
come from an Aho-Corasick automaton over the vocabulary; a token t fits after the prefix before it if the
last token p of that prefix and t are compatible: encoding the two strings together gives p and t again.
That is tested on the merge trees alone: going back from p and t, the later merge on either side of the
border is undone, and no pair that faces the border may merge earlier than what was undone last. The last tokens are
followed back from the end of the word.

The tokenizer file's own steps come first: special tokens are cut out of the raw text; NFC; white space to
one space; lower case by code point; its pattern picks the words; bytes become its letters.

Defined cases: null and empty texts have no tokens and decode to the empty text; rows keep their
number, repeated or not; an empty table gives an empty table; other columns are ignored. Texts
are encoded whole; words of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: A word's last letter is moved up by so much instead of carrying the end mark.
END = 0x1000
#: Words that a worker remembers at most, and the longest of them.
REMEMBERED, LONGEST = 240_000, 48
#: Pairs of tokens whose compatibility it remembers at most.
PAIRS = 150_000
#: Characters that are encoded together.
PORTION = 300_000
#: From here on the tables of regex and of Python can differ.
HIGH = re.compile("[\u0530-\U0010ffff]")
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def category(kind: str) -> str:
    """The code points of a major Unicode category, as ranges for a character class."""
    out, first = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == kind
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{i - 1:08x}")
            first = None
    return "".join(out)


class Memory:
    """What a function gives for words. Two halves: when the newer is full it becomes the older, whose words are forgotten unless they were asked for again."""

    def __init__(self, function, size: int):  # noqa: ANN001
        self.function, self.size = function, size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.function(word)
            if len(word) <= LONGEST:
                if len(self.new) * 2 >= self.size:
                    self.old, self.new = self.new, {}
                self.new[word] = found
        return found


class WordBpe:
    """Encoder for a tokenizers file with a BPE model whose tokens at the end of a word carry a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError("not a BPE file with word ends and without a decoder")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.cutter = re.compile("(" + "|".join(sorted(map(re.escape, self.specials), key=len, reverse=True)) + ")") if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's pattern engine: \s is Unicode white space; letters and numbers are those of Python's Unicode tables, not of the newer ones in regex
        pattern = split["pattern"]["Regex"].replace("[^\\s", "[^\\p{White_Space}")
        self.wide_pattern = regex.compile(pattern.replace("\\p{L}", category("L")).replace("\\p{N}", category("N")))
        self.pattern = regex.compile(pattern)  # quicker, and the same below HIGH
        self.letters = byte_letters()
        self.left, self.right, self.rank, self.merge = {}, {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.left.setdefault(made, x)
            self.right.setdefault(made, y)
            self.rank.setdefault(made, rank)
            self.merge[x, y] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            inner = self.inner(token)
            self.automaton.add_word(inner, (i, len(inner)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.ids_of = Memory(lambda w: np.array(self.encode_word(w), "<u4").tobytes(), REMEMBERED)
        self.name_array = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.string())

    def inner(self, token: str) -> str:
        if not token.endswith(self.suffix) or token == self.suffix:
            return token
        bare = token[: -len(self.suffix)]
        return bare[:-1] + chr(ord(bare[-1]) + END)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b survives the merging of their joint text."""
        limit, left_undone = 1 << 60, False
        while True:
            crossing = self.merge.get((a, b))
            # of equal pairs the one further left merges first
            if crossing is not None and (crossing < limit or crossing == limit and not left_undone):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb or ra == rb:
                # equal ranks: the right one was made after the left one, so it is undone first
                if ra == rb:
                    limit, b, left_undone = rb, self.left[b], False
                else:
                    limit, a, left_undone = ra, self.right[a], True
            else:
                limit, b, left_undone = rb, self.left[b], False

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (a match of the pattern)."""
        mapped = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))
        inner = mapped[:-1] + chr(ord(mapped[-1]) + END)
        n = len(inner)
        last, size = [-1] * n, [0] * n
        fits = self.fits
        # matches come by their end, the longest first
        for end, (token, length) in self.automaton.iter(inner):
            if last[end] < 0:
                before = end - length
                if before >= 0:
                    pair = last[before] << 20 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = self._compatible(last[before], token)
                        if len(fits) < PAIRS:
                            fits[pair] = fit
                    if not fit:
                        continue
                last[end], size[end] = token, length
        if min(last) < 0:
            raise ValueError(f"no token ends a prefix of {word!r}")
        ids, i = [], n - 1
        while i >= 0:
            ids.append(last[i])
            i -= size[i]
        return ids[::-1]

    def words(self, text: str) -> Iterator[str | int]:
        """Words of a text and ids of special tokens, in order."""
        for part in self.cutter.split(text) if self.cutter and "<" in text else (text,):
            if part in self.specials:
                yield self.specials[part]
            elif part:
                yield from self.find(self.normalised(part))

    def find(self, text: str) -> list[str]:
        return (self.wide_pattern if HIGH.search(text) else self.pattern).findall(text)

    @staticmethod
    def normalised(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
        return text.lower()

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in ([w] if isinstance(w, int) else self.encode_word(w))]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file: the tokens joined by spaces."""
        return " ".join(self.names[i] for i in ids)

    def many(self, texts: list[str]) -> tuple[list[np.ndarray], pa.StringArray]:
        """Ids and decoded text of each text; each distinct word of them all is looked up once."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            for part in self.cutter.split(text) if self.cutter and "<" in text else (text,):
                if part in self.specials:
                    words.append(part)  # no match of the pattern looks like one
                elif part:
                    words += self.find(self.normalised(part))
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().astype(np.int64)
        found = [np.array([self.specials[w]], "<u4").tobytes() if w in self.specials else self.ids_of(w) for w in names]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        after = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(starts[at] - after[:-1], each) + np.arange(after[-1])]
        cuts = after[np.array(ends)]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), self.name_array.take(pa.array(ids)))
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pc.binary_join(lists, " ")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of the decoded text."""
        (ids,), texts = self.many([text])
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[0].as_buffer() or b"").hexdigest()


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """Texts without null, some PORTION characters at a time."""
    held, n = [], 0
    for t in texts:
        text = t.as_py() or ""
        held.append(text)
        n += len(text)
        if n >= PORTION:
            yield held
            held, n = [], 0
    if held:
        yield held
    pa.default_memory_pool().release_unused()


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in batches:
        n, coded, plain = [], [], []
        for texts in portions(batch.column(1)):
            ids, decoded = bpe.many(texts)
            n += map(len, ids)
            coded += [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            plain += [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in decoded]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_digests, path=path), ENCODED)


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in batches:
        at = 0
        for texts in portions(batch.column(1)):
            found, _ = bpe.many(texts)
            sizes = [len(x) for x in found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])
            at += len(texts)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids: array of int."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_ids, path=path), "doc_id long, n_tokens long, ids array<int>")


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids."""
    return pick(ids, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(partial(_texts, path=path), "doc_id long, text string")
