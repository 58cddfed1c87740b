"""Near-duplicate texts by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 64 bits; a bit is set if it is in over half the XXH64 hashes of the text's word shingles, repeats
included. Fingerprints link at radius differing bits or fewer.

Masks. Each of the bits that two fingerprints may differ in gets a number from 1 to 2**(radius + 1) - 1, in turn, read as a vector of
radius + 1 bits. For each vector v but zero there is a table: fingerprints with equal bits wherever the bit's vector has an odd product
with v fall into one bucket. The vectors of radius bits span less than all vectors, so some v has an even product with all of them:
whatever radius bits or fewer two fingerprints differ in, some table ignores them all. No link is missed.

1. Equal fingerprints are one node.
2. Every node falls into a bucket of each table. The least fingerprint of a bucket is its hub; the others are
   linked with it where they are near enough, and links are joined to components.
3. Buckets with nodes of one component are done with. In the others, of up to DIRECT nodes, nodes of different components are compared.
4. Larger buckets are dealt out anew, by masks of the same kind over the bits that their table ignores (30, then 14 of 64 bits): steps 2 and 3 again.
   When 8 bits or fewer are left, a bucket has 2**8 nodes at most, and is compared whatever its size.

So the cost of a bucket of many near copies is a few rows a node and level, and no pair is dropped.

Defined cases: null, empty and blank texts have no words and the fingerprint zero, which links like any other; texts of fewer words than a
shingle have one shingle of all their words. Null doc_ids don't count for a component's smallest doc_id, which is
null only where there is no other; repeated rows have a row each. Other columns don't matter, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .components import components, joined_components
from .tokens import raw_texts, runs, spaced_words

BITS = 64
SEED = 42
#: Nodes of a bucket that are compared with each other as they are.
DIRECT = 64
#: With so many bits left that may differ, buckets are not dealt out further.
LAST_BITS = 8


def fingerprint(raw: memoryview, words: int) -> int:
    """Fingerprint of a text's bytes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), 0
    short: list[bytes] = []  # the words of a text that has no full shingle
    lists = spaced_words(raw)
    if words > 1:

        def noted(found: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
            for piece in found:
                if len(short) < words:
                    short.extend(piece[: words - len(short)])
                yield piece

        lists = noted(lists)
    for shingles in runs(lists, words, words):
        if shingles:
            hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
            for at in range(0, len(hashes), 1 << 16):
                part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += part.sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n:
        return digest(b" ".join(short), SEED) if short else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(raw, words) for raw in raw_texts(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long) for every row of doc_id, text."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), "doc_id long, print long")


@cache
def masks(free: int, radius: int) -> tuple[int, ...]:
    """Of each table: the bits that it compares, out of those that may differ (set in free)."""
    places = [b for b in range(BITS) if free >> b & 1]
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(len(places))]
    return tuple(sum(1 << b for b, x in zip(places, vectors, strict=True) if (x & v).bit_count() % 2) for v in range(1, 1 << radius + 1))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


class Level:
    """Tables of one level: ids from 0 on, what each compares in all, and its tables on the next level."""

    def __init__(self, compared: list[int], radius: int):
        self.compared, self.radius = compared, radius

    def next(self) -> Level:
        every = (1 << BITS) - 1
        return Level([c | m for c in self.compared for m in masks(every & ~c, self.radius)], self.radius)

    def last(self) -> bool:
        return min(c.bit_count() for c in self.compared) >= BITS - LAST_BITS

    def tables(self, parent: Column | None) -> Column:
        """Array of table ids of this level: of all, or those below a table of the level before."""
        if parent is None:
            return F.sequence(F.lit(0), F.lit(len(self.compared) - 1))
        width = (1 << self.radius + 1) - 1
        return F.sequence(parent * width, parent * width + (width - 1))

    def mask(self, table: Column) -> Column:
        return F.element_at(F.lit(np.array([signed(c) for c in self.compared], np.int64)), table + 1)


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _of_component(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with root: the component of column print, or itself."""
    if roots is None:
        return rows.withColumn("root", F.col("print"))
    its = roots.select(F.col("node").alias("its"), "root")
    return rows.join(its, rows["print"] == its["its"], "left").withColumn("root", F.coalesce("root", "print")).drop("its")


def prints_roots(prints: DataFrame, radius: int = 3, direct: int = DIRECT) -> DataFrame:
    """node, root of the distinct fingerprints (column print) that link with others; written."""
    level = Level(list(masks((1 << BITS) - 1, radius)), radius)
    rows = prints.select("print", F.explode(level.tables(None)).alias("table"))
    roots: DataFrame | None = None
    while True:
        members = rows.withColumn("bucket", F.col("print").bitwiseAND(level.mask(F.col("table"))))
        buckets = members.groupBy("table", "bucket").agg(F.min("print").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        its = buckets.select(F.col("table").alias("its_table"), F.col("bucket").alias("its_bucket"), "hub", "n")
        # a join of two plain shuffles, which adaptive execution splits where a bucket is large
        held = cut(members.join(its, (F.col("table") == F.col("its_table")) & (F.col("bucket") == F.col("its_bucket"))).select("table", "bucket", "print", "hub", "n"))
        links = held.filter((F.col("print") != F.col("hub")) & near(F.col("print"), F.col("hub"), radius))
        roots = _joined(roots, links.select(F.col("print").alias("a"), F.col("hub").alias("b")))
        known = _of_component(held.filter("n > 2").drop("hub"), roots)
        mixed = known.groupBy("table", "bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
        open_ = cut(known.join(mixed.select(F.col("table").alias("its_table"), F.col("bucket").alias("its_bucket")), (F.col("table") == F.col("its_table")) & (F.col("bucket") == F.col("its_bucket")), "left_semi"))
        small = open_ if level.last() else open_.filter(F.col("n") <= direct)
        other = small.select(F.col("table").alias("its_table"), F.col("bucket").alias("its_bucket"), F.col("print").alias("other"), F.col("root").alias("other_root"))
        same = (F.col("table") == F.col("its_table")) & (F.col("bucket") == F.col("its_bucket")) & (F.col("print") < F.col("other"))
        links = small.join(other, same & (F.col("root") != F.col("other_root")) & near(F.col("print"), F.col("other"), radius))
        roots = _joined(roots, links.select(F.col("print").alias("a"), F.col("other").alias("b")))
        large = open_.filter(F.col("n") > direct)
        if level.last() or large.isEmpty():
            return roots
        level = level.next()
        rows = large.select("print", F.explode(level.tables(F.col("table"))).alias("table"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    links = cut(links.distinct())
    return cut(components(links) if roots is None else joined_components(roots, links))


def near_copies(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links) for every row."""
    rows = cut(fingerprints(docs, words))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    rooted = _of_component(prints, prints_roots(prints.select("print"), radius))
    least = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    known = cut(rooted.join(least, rooted["root"] == least["of"]).select(F.col("print").alias("its"), "component_id"))
    # of two plain shuffles, as above: a fingerprint may be that of a third of all rows
    full = rows.join(known, rows["print"] == known["its"], "left")
    return full.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
