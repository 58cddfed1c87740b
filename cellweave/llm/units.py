"""Substring dedup by hashing lines or paragraphs. Passages that begin or end inside a line need module passages.

A unit is a line of at least min_words words, or a paragraph (lines up to a blank one), or a run: consecutive lines that
have min_words words together, blank lines between them aside. Runs find passages laid out in short lines; from each line on
and up to each line the shortest run is taken, which covers every repeated run whatever surrounds it. Units are compared by the
128-bit BLAKE2 digest of their words in lower case joined by single spaces. Of equal units the one with the smallest
(doc_id, start) stays; the others are removed, and listed with their offsets in the original text.

Defined cases: null and empty texts have no units; rows without doc_id rank last; of rows equal in doc_id and
text one keeps its unit (n_rows counts the rows that lose it); a unit twice in a text goes the second time; an empty
table gives an empty table; other columns are ignored. Runs that are removed may overlap, also with the run they repeat (as where one
line is repeated many times); the first of equal lines stays in any case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, text_key, without

SPLIT = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
FOUND = "key long, doc_id long, unit long, start long, end long, n_words long, digest binary"
GONE = ("doc_id", "unit", "start", "end", "n_words", "n_rows", "keep_doc_id", "keep_start", "keep_end")


def cut_text(text: str, kind: str) -> list[tuple[int, int]]:
    """Start and end of each unit, code points, end exclusive."""
    out, at = [], 0
    for m in SPLIT[kind].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def fingerprint(unit: str) -> tuple[int, bytes]:
    words = unit.lower().split()
    return len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shortest(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """First and last (exclusive) of the shortest runs of so many words from each place on, and up to each place."""
    found, j, n = set(), 0, 0
    for i, size in enumerate(sizes):
        while j < len(sizes) and n < least:
            n += sizes[j]
            j += 1
        if n >= least:
            found.add((i, j))
        n -= size
    i, n = len(sizes), 0
    for j in range(len(sizes), 0, -1):
        while i > 0 and n < least:
            i -= 1
            n += sizes[i]
        if n >= least:
            found.add((i, j))
        n -= sizes[j - 1]
    return sorted(found)


def pieces(text: str, kind: str, min_words: int) -> list[tuple[int, int, int]]:
    """Number, start and end of what may be units."""
    if kind != "run":
        return [(k, a, b) for k, (a, b) in enumerate(cut_text(text, kind))]
    lines = [(k, a, b, n) for k, (a, b) in enumerate(cut_text(text, "line")) if (n := len(text[a:b].split()))]
    return [(lines[i][0], lines[i][1], lines[j - 1][2]) for i, j in shortest([x[3] for x in lines], min_words)]


def _scan(batches: Iterator[pa.RecordBatch], kind: str, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            body = text.as_py() or ""
            for k, a, b in pieces(body, kind, min_words):
                if b - a < 2 * min_words - 1:
                    continue
                n, digest = fingerprint(body[a:b])
                if n >= min_words:
                    for column, value in zip(out, (key, doc, k, a, b, n, digest), strict=True):
                        column.append(value)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def units(docs: DataFrame, kind: str = "line", min_words: int = 50) -> DataFrame:
    """key (of the text), doc_id, unit, start, end, n_words, digest of every unit that is long enough."""
    rows = pick(docs, "doc_id", "text").select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_scan, kind=kind, min_words=min_words), FOUND)


def _gone(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """The columns GONE with key (of the text) and twin: of the rows equal in doc_id and text one keeps the unit."""
    found = cut(units(docs, kind, min_words))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "end", "key")
    groups = found.groupBy("digest").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # cut: a join of two plain shuffles, which adaptive execution splits where a unit is in many texts
    groups = cut(groups.select(F.col("digest").alias("of"), "keep"))
    hits = found.join(groups, found["digest"] == groups["of"]).drop("of", "digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start")) & (F.col("end") == F.col("keep.end")) & (F.col("key") == F.col("keep.key"))
    others = hits.filter(~same).withColumn("n_rows", F.lit(1).cast("long")).withColumn("twin", F.lit(False))
    # rows equal to the one that stays: all but one lose the unit
    twins = hits.filter(same).groupBy("key", "doc_id", "unit", "start", "end", "n_words", "keep").agg((F.count(F.lit(1)) - 1).alias("n_rows")).filter("n_rows > 0")
    rows = others.unionByName(twins.withColumn("twin", F.lit(True)))
    return rows.withColumns({f"keep_{c}": F.col(f"keep.{c}") for c in ("doc_id", "start", "end")}).select(*GONE, "key", "twin")


def repeated_units(docs: DataFrame, kind: str = "line", min_words: int = 50) -> DataFrame:
    """What goes: doc_id, unit, start, end, n_words, n_rows, and keep_doc_id, keep_start, keep_end of the unit that stays."""
    return _gone(docs, kind, min_words).select(*GONE)


def without_units(docs: DataFrame, kind: str = "line", min_words: int = 50) -> DataFrame:
    """doc_id, text without the repeated units (their separators stay), removed: array of {start, end} in the old text; those of runs may overlap.

    A row for every row; of rows equal in doc_id and text one keeps the units that stay.
    """
    return without(docs, _gone(docs, kind, min_words))
