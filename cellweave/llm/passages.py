"""Substring dedup by hashing passages: windows of so many words in a row, wherever they begin and end.

Lines and paragraphs (module units) miss a passage that begins or ends inside a line, so here every window of least words
is a unit: normalised (A-Z in lower case, words joined by single spaces), hashed to 128 bits and grouped over all rows. Of
equal windows the one with the smallest (doc_id, start) stays, the others are removed; windows of a text that overlap or
touch are joined to one span with its offsets in the original text. So every passage of least words or more goes
wherever it comes again, and nothing else does.

To hash each window of all texts would shuffle a row a word. Windows are searched in steps instead:

1. Each window is named by the smallest hash of the shorter windows (half of it) inside: neighbours mostly share it, equal windows always do.
   Names seen in one text only are dropped; those of two and more texts, or of equal windows in one text, are joined back to their texts.
2. Those texts are read once more; only windows with such a name are hashed and grouped.
3. Rows with equal texts are one text: all but the first row lose it whole, if it has least words.

Every step is a hash aggregate, or a join of two plain shuffles that adaptive execution can split where a passage is in a large share of rows.

Defined cases: null and empty texts, and texts of fewer words, have no windows; rows without doc_id rank last; of rows equal in
doc_id and text all but one lose the text (n_rows counts them); a passage twice in a text goes the second time, also where the
two overlap; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick, scratch, without
from .shingles import chunks, mixed, word_codes

LEAST = 50
#: Bytes of text that a task has arrays for at a time (or one text).
PART = 1 << 18
#: Odd multipliers of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, PART // 4), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _powers[base] = held
    return held[:n]


def rolled(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each window of k codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(base, len(codes)), dtype=np.uint64)))
    return mixed((sums[k:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n))


def least_of(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    span = 1
    while 2 * span <= w and len(x) > span:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if len(x) > w - span else x[:0]


class Windows:
    """All windows of least words of the texts of a chunk: text (its number), at (first word), name; offsets of words in code points."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray, least: int):
        self.codes, starts, sizes, firsts = word_codes(raw, begins)
        self.least, self.bounds = least, np.append(firsts, len(self.codes))
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        owner = np.repeat(np.arange(len(begins)), np.diff(self.bounds))
        zero = points[begins][owner]
        self.starts, self.ends = points[starts] - zero, points[starts + sizes] - zero
        inside = np.arange(max(0, len(self.codes) - least + 1))
        self.at = inside[inside + least <= self.bounds[1:][owner[: len(inside)]]]
        self.text = owner[self.at]
        half = max(1, least // 2)
        self.names = least_of(rolled(self.codes, half, BASES[0]), least - half + 1)[self.at]

    def hashes(self, base: int) -> np.ndarray:
        return rolled(self.codes, self.least, base)[self.at]

    def again(self) -> np.ndarray:
        """Which windows are equal to another one of their text."""
        found = self.hashes(BASES[0])
        out = np.zeros(len(found), bool)
        ordered = np.sort(found)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            some = np.flatnonzero(np.isin(found, twice))
            some = some[np.lexsort((found[some], self.text[some]))]
            same = (found[some][1:] == found[some][:-1]) & (self.text[some][1:] == self.text[some][:-1])
            out[some[np.append(same, False) | np.append(False, same)]] = True
        return out


NAMED = "key long, other long, doc_id long, name long, again boolean, start long, end long, n_words long"


def _batch(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c.cast(kinds[k]) if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _name(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The names of each text's windows, once for each stretch of windows that share one; and a row without a name for the text itself."""
    for batch in batches:
        key, other, doc_id = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for first, raw, begins in chunks(batch.column(3), PART):
            if not len(raw):
                continue
            w = Windows(raw, begins, least)
            if not len(w.at):
                continue
            some = np.flatnonzero(np.append(True, (w.names[1:] != w.names[:-1]) | (w.text[1:] != w.text[:-1])))
            texts = np.unique(w.text)
            whole = np.arange(len(some) + len(texts)) >= len(some)
            owner = np.concatenate((w.text[some], texts))
            pad = lambda x, owner=owner, whole=whole: pa.array(np.where(whole, x[owner], 0), pa.int64(), mask=~whole)
            a, b = w.bounds[:-1], w.bounds[1:]
            names = pa.array(np.concatenate((w.names[some], np.zeros(len(texts), np.uint64))).view(np.int64), pa.int64(), mask=whole)
            again = np.append(np.logical_or.reduceat(w.again(), some), np.zeros(len(texts), bool))
            starts, ends = w.starts[np.minimum(a, len(w.starts) - 1)], w.ends[np.maximum(b, 1) - 1]
            yield _batch(NAMED, key[first + owner], other[first + owner], doc_id.take(pa.array(first + owner)), names, again, pad(starts), pad(ends), pad(b - a))


WINDOWS = "key long, doc_id long, high long, low long, word int, start int, end int"


def _hash(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The windows that have one of the names in question."""
    for batch in batches:
        key, doc_id, wanted = batch.column(0).to_numpy(), batch.column(1), batch.column(3)
        for first, raw, begins in chunks(batch.column(2), PART):
            if not len(raw):
                continue
            w = Windows(raw, begins, least)
            names = wanted.slice(first, len(begins)).flatten().to_numpy().view(np.uint64)
            # a name of one text here is in question for all of them
            some = np.flatnonzero(np.isin(w.names, names))
            if not len(some):
                continue
            owner, at = first + w.text[some], w.at[some]
            hashes = [w.hashes(b)[some].view(np.int64) for b in BASES]
            yield _batch(WINDOWS, key[owner], doc_id.take(pa.array(owner)), *hashes, at - w.bounds[w.text[some]], w.starts[at], w.ends[at + least - 1])


def _rank(doc_id: Column, *more: Column | str) -> Column:
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), *more)


def _keyed(docs: DataFrame) -> DataFrame:
    """key and other (128 bits of the text), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("other"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


GONE = ("doc_id", "start", "end", "n_words", "n_rows", "keep_doc_id", "keep_start")


def _gone(rows: DataFrame, least: int) -> DataFrame:
    """The columns GONE with key (of the text) and twin: of the rows equal in doc_id and text one keeps it."""
    with scratch(rows.mapInArrow(partial(_name, least=least), NAMED)) as named:
        names = named.filter("name is not null").select("key", "other", "name", "again")
        several = names.groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("again").alias("again")).filter("a <> b or again")
        several = cut(several.select(F.col("name").alias("its")))
        wanted = names.join(several, names["name"] == several["its"]).groupBy("key", "other").agg(F.collect_set("name").alias("names"))
        wanted = cut(wanted.withColumnsRenamed({"key": "its_key", "other": "its_other"}))
        copies = cut(_copies(named.filter("name is null").drop("name", "again")))
    texts = rows.groupBy("key", "other").agg(F.first("text").alias("text"), F.min(_rank(F.col("doc_id"))).alias("first"))
    texts = texts.join(wanted, (texts["key"] == wanted["its_key"]) & (texts["other"] == wanted["its_other"]))
    texts = texts.select("key", F.col("first.doc_id").alias("doc_id"), "text", "names")
    with scratch(texts.mapInArrow(partial(_hash, least=least), WINDOWS)) as windows:
        keep = windows.groupBy("high", "low").agg(F.min(_rank(F.col("doc_id"), "start", "key")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        keep = keep.select(F.col("high").alias("its_high"), F.col("low").alias("its_low"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), F.col("keep.key").alias("keep_key"))
        with scratch(keep) as keep:
            both = windows.join(keep, (windows["high"] == keep["its_high"]) & (windows["low"] == keep["its_low"]))
            others = both.filter((F.col("key") != F.col("keep_key")) | (F.col("start") != F.col("keep_start")))
            spans = cut(_spans(others, least))
    found = spans.select("key", *[F.col(c).cast("long").alias(c) for c in GONE if c != "n_rows"], F.lit(1).cast("long").alias("n_rows"), F.lit(False).alias("twin"))
    # a copy's first window stays where that of the first row does
    lead = spans.filter("word = 0").select(F.col("key").alias("its_key"), F.col("doc_id").alias("its_id"), F.col("keep_doc_id").alias("lead_id"), F.col("keep_start").cast("long").alias("lead_start"))
    led = copies.join(lead, (copies["key"] == lead["its_key"]) & copies["first"].eqNullSafe(lead["its_id"]), "left")
    moved = F.col("its_key").isNotNull()
    led = led.select("key", "doc_id", "start", "end", "n_words", "n_rows", F.when(moved, F.col("lead_id")).otherwise(F.col("first")).alias("keep_doc_id"), F.when(moved, F.col("lead_start")).otherwise(F.col("start")).alias("keep_start"), F.col("doc_id").eqNullSafe(F.col("first")).alias("twin"))
    return found.unionByName(led)


def _copies(texts: DataFrame) -> DataFrame:
    """Rows that repeat a text whole: key, doc_id, n_rows, first (doc_id of the row that keeps it), start, end, n_words."""
    each = texts.groupBy("key", "other", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min("end").alias("end"), F.min("n_words").alias("n_words"))
    firsts = each.groupBy("key", "other").agg(F.min(_rank(F.col("doc_id"))).alias("first"), F.sum("n").alias("total")).filter("total > 1")
    firsts = cut(firsts.select(F.col("key").alias("its_key"), F.col("other").alias("its_other"), F.col("first.doc_id").alias("first")))
    both = each.join(firsts, (each["key"] == firsts["its_key"]) & (each["other"] == firsts["its_other"]))
    lost = F.col("n") - F.col("doc_id").eqNullSafe(F.col("first")).cast("long")
    return both.withColumn("n_rows", lost).filter("n_rows > 0").select("key", "doc_id", "n_rows", "first", "start", "end", "n_words")


def _spans(windows: DataFrame, least: int) -> DataFrame:
    """Windows of a text that overlap or touch as one: key, doc_id, word (the first), start, end, n_words, and where the first window stays."""
    order = Window.partitionBy("key", "doc_id").orderBy("word")
    before = F.lag("word").over(order)
    marked = windows.withColumn("new", (before.isNull() | (F.col("word") > before + least)).cast("int"))
    numbered = marked.withColumn("span", F.sum("new").over(order))
    groups = numbered.groupBy("key", "doc_id", "span")
    # the first window is the one that begins a span
    first = F.col("new") == 1
    return groups.agg(
        F.min("word").alias("word"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("word") - F.min("word") + least).alias("n_words"),
        F.max(F.when(first, F.col("keep_doc_id"))).alias("keep_doc_id"),
        F.max(F.when(first, F.col("keep_start"))).alias("keep_start"),
    )


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """What goes: doc_id, start, end (code points, end exclusive), n_words, n_rows, and keep_doc_id, keep_start of what the first window repeats."""
    return _gone(_keyed(docs), least).select(*GONE)


def without_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text without the repeated passages, removed: array of {start, end} in the old text; a row for every row."""
    return without(docs, _gone(_keyed(docs), least))
