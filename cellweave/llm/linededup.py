"""Line dedup by how often a line is seen within a site, DataFrame functions only.

A line is boilerplate of a host when at least min_pages of its pages hold it and the pages that
hold it are more than max_ratio of all pages of the host. Every page loses all boilerplate lines of
its host; the other lines stay as they were, joined by newlines.

Counted so, a text with many copies on a host loses all its lines in every copy. Where copies are removed only later,
by_text counts each different text of a host as one page, however many rows hold it, and a page that would lose
more than most_lost of its characters (blanks aside) keeps all its lines: it is a near copy, not a page with boilerplate.

Defined cases: a null text stays null and counts as a page without lines; an empty text stays empty; lines
that are blank once trimmed are never dropped; a null host is a host of its own; each row is a
page, so repeated rows count as pages of their own (with by_text all null texts of a host are one page); rows with the same doc_id keep apart as far as
their hosts differ; an empty table gives an empty table.
Lines are compared by the 128-bit MD5 of the line without white space at its ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, packed, pick, text_key, unpacked

#: Copies of each host's page total, so that a large host is joined by many tasks.
SALTS = 64


@dataclass(frozen=True)
class Limits:
    max_ratio: float = 0.01
    min_pages: int = 5
    by_text: bool = False
    most_lost: float = 1.0


def digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary")))


def n_marks(lines: Column) -> Column:
    """Characters of all lines, blanks aside."""
    return F.length(F.translate(F.array_join(lines, ""), BLANKS, ""))


def boilerplate(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """Rows host, line (digest), pages, of_pages: the lines to drop."""
    pages = pick(docs, "text", host).withColumnRenamed(host, "host")
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    found = F.array_distinct(F.transform(lines, digest))
    if limits.by_text:
        pages = pages.groupBy("host", F.unhex(F.md5(F.col("text").cast("binary"))).alias("whole")).agg(F.first(found).alias("lines"))
        each = pages.select("host", F.explode("lines").alias("line"))
    else:
        each = pages.select("host", F.explode(found).alias("line"))
    seen = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= limits.min_pages)
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of_pages"))
    totals = totals.select(F.col("host").alias("of"), "of_pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    joined = seen.join(totals, seen["host"].eqNullSafe(totals["of"]) & (seen["salt"] == totals["part"]))
    return joined.filter(F.col("pages") > F.col("of_pages") * F.lit(limits.max_ratio)).select("host", "line", "pages", "of_pages")


def dropped_lines(docs: DataFrame, lines: DataFrame, host: str = "source") -> DataFrame:
    """Rows doc_id, host, key (of the text), gone: a byte for each line up to the last that the pages of that doc_id, host and text have to lose, 1 for those."""
    pages = pick(docs, "doc_id", "text", host).withColumnRenamed(host, "host").withColumn("key", text_key(F.col("text")))
    each = pages.select("doc_id", "host", "key", F.posexplode(F.split("text", "\n")).alias("place", "bare")).filter(F.btrim("bare", F.lit(BLANKS)) != "")
    each = each.select("doc_id", "host", "key", "place", digest(F.col("bare")).alias("line"))
    known = lines.select(F.col("host").alias("of"), F.col("line").alias("known"))
    hits = each.join(known, each["host"].eqNullSafe(known["of"]) & (each["line"] == known["known"]), "left_semi")
    found = hits.groupBy("doc_id", "host", "key").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # bytes, not a set: a look into it takes as long however many lines go
    gap = F.transform("places", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get(F.col("places"), i - 1)).otherwise(-1) - 1), F.lit("1")))
    return found.select("doc_id", "host", "key", F.array_join(gap, "").cast("binary").alias("gone"))


def thinned(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """Columns row, text (thinned), n_lines, n_dropped for every document."""
    lines = cut(boilerplate(docs, limits, host))
    gone = dropped_lines(docs, lines, host).select(F.col("doc_id").alias("its_id"), F.col("host").alias("of"), F.col("key").alias("its_key"), "gone")
    whole = packed(docs, "doc_id", "text", host).withColumnRenamed(host, "host").withColumn("key", text_key(F.col("text")))
    both = whole.join(gone, whole["doc_id"].eqNullSafe(gone["its_id"]) & whole["host"].eqNullSafe(gone["of"]) & (whole["key"] == gone["its_key"]), "left")
    split = both.select("row", "doc_id", "gone", F.split("text", "\n").alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: F.substring(F.col("gone"), i + 1, F.lit(1)) != F.lit(b"1")))
    if limits.most_lost < 1:
        left = n_marks(kept) < n_marks(F.col("lines")) * F.lit(1 - limits.most_lost)
        kept = F.when(F.col("gone").isNull() | left, F.col("lines")).otherwise(kept)
    split = split.select("row", "doc_id", "lines", kept.alias("kept"))
    return split.select(
        "row",
        "doc_id",
        F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def lines_filter(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The documents with their boilerplate lines gone; no document goes."""
    done = thinned(docs, limits, host)
    new = {docs.columns[i]: F.col("text") for i, c in enumerate(docs.columns) if c.lower() == "text"}
    if any(c.lower() == "n_chars" for c in docs.columns):
        name = next(c for c in docs.columns if c.lower() == "n_chars")
        new[name] = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return unpacked(done, docs.columns, **new)
