"""Importance resampling towards a target, by hashed n-gram features.

A text's features are its runs of 1 to n words, repeats included; a feature's bucket is the CRC32 of its bytes modulo the number of buckets.
A bucket's gain is floor(1000 ln) of its smoothed share in the target's features over that in the documents', a document's weight the
floored mean of its features' gains. Of the documents with enough words the given share is drawn, by weight plus Gumbel noise
made of the doc_id: the greatest scores, which is drawing without replacement in proportion to exp(weight / 1000).

Distinct-feature dictionary:

1. Features are counted in tasks, then globally: one row a distinct feature. Each of these is hashed once, and buckets are sums over them.
2. Gains (a row a bucket) are joined to the distinct features.
3. The documents' feature counts, made again rather than kept, are joined with them. The most frequent features, FREQUENT at most and of SHORT
   bytes at most each (51 MB), are broadcast, and their rows are summed by document where they are; the rows of all others are joined by shuffle.
   How many are as frequent as that is read from numbers of features by the logarithm of their count, so no feature has to be ranked.
4. Documents are numbered in the order of score by a range sort: no task sees all.

Defined cases: null, empty and blank texts have no features and weight 0. A null doc_id is hashed like an empty one and ranks last among ties.
Rows equal in doc_id and text score the same and have ranks in turn. An empty table gives no rows; with an empty target all gains come of
the smoothing. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.counts import dense_index
from .common import cut, pick, scratch, text_key
from .tokens import plain_words, raw_texts, runs

#: Distinct features that are broadcast at most, and the bytes that each has at most.
FREQUENT, SHORT = 200_000, 256
#: Steps of a count for each doubling.
STEPS = 8
#: Distinct features that a task counts before it hands them on.
HELD = 500_000
#: Rows of feature counts that go to Spark at a time.
ROWS = 50_000


@dataclass(frozen=True)
class Draw:
    """n: words of the longest runs; the percent of the documents with least_words or more that is drawn."""

    n: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def _rows(columns: list[list], fields: list[pa.Field]) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.binary()).cast(pa.string()) if f.type == pa.string() else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """feature, n: counts of this task, in parts."""
    fields = [pa.field("feature", pa.string()), pa.field("n", pa.int64())]
    held: Counter[bytes] = Counter()

    def handed() -> Iterator[pa.RecordBatch]:
        names, counts = list(held), list(held.values())
        for at in range(0, len(names), ROWS):
            yield _rows([names[at : at + ROWS], counts[at : at + ROWS]], fields)
        held.clear()

    for batch in batches:
        for raw in raw_texts(batch.column(0)):
            for features in runs(plain_words(raw), 1, n):
                held.update(features)
                if len(held) > HELD:
                    yield from handed()
    yield from handed()


BY_DOCUMENT = "doc_id long, key long, feature string, n long, words long, copies long"


def _by_document(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each document and distinct feature, in parts for very long texts, and one (without a feature) for the document: its words, and that it is one."""
    fields = [pa.field(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in BY_DOCUMENT.split(", ")]
    out: list[list] = [[] for _ in fields]

    def noted(doc, key, features: dict[bytes, int]) -> None:  # noqa: ANN001
        for column, values in zip(out, ([doc] * len(features), [key] * len(features), features, features.values(), [0] * len(features), [0] * len(features)), strict=True):
            column.extend(values)

    def taken() -> pa.RecordBatch:
        made = _rows(out, fields)
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for doc, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            held: Counter[bytes] = Counter()
            words = 0

            def lists(raw: memoryview = raw) -> Iterator[list[bytes]]:
                nonlocal words
                for found in plain_words(raw):
                    words += len(found)
                    yield found

            for features in runs(lists(), 1, n):
                held.update(features)
                if len(held) > ROWS:
                    noted(doc, key, held)
                    held.clear()
                    yield taken()
            noted(doc, key, held)
            for column, value in zip(out, (doc, key, None, 0, words, 1), strict=True):
                column.append(value)
            if len(out[0]) > ROWS:
                yield taken()
    yield taken()


def dictionary(texts: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """feature, n, bucket of the distinct features of column text: each is hashed once."""
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_counted, n=draw.n), "feature string, n long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(draw.buckets)).cast("int"))


def gains(source: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """bucket, gain (long) of every bucket; from the dictionaries of both sides."""
    sums = []
    for name, side in (("s", source), ("t", target)):
        sums.append(side.groupBy(F.col("bucket").alias(f"{name}_bucket")).agg(F.sum("n").alias(name)))
    buckets = source.sparkSession.range(draw.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = buckets.join(sums[0], F.col("bucket") == F.col("s_bucket"), "left").join(sums[1], F.col("bucket") == F.col("t_bucket"), "left")
    both = cut(both.select("bucket", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in "st"]), draw.buckets)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()  # of a row a bucket
    ratio = ((F.col("t") + 1.0) * (all_s + draw.buckets)) / ((F.col("s") + 1.0) * (all_t + draw.buckets))
    return both.select("bucket", F.floor(F.ln(ratio) * 1000.0).alias("gain"))


def _step(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * STEPS)


def _least_step(known: DataFrame, frequent: int) -> int:
    """The least step of a count that at most so many short features have or exceed."""
    steps = known.filter(F.octet_length("its") <= SHORT).groupBy(_step(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    least, held = 64 * STEPS, 0
    for row in sorted(steps.collect(), reverse=True):  # some hundred rows at most
        held += row["n"]
        if held > frequent:
            break
        least = row["step"]
    return least


def weights(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), frequent: int = FREQUENT) -> DataFrame:
    """doc_id, key (of the text), n_words, n_features, weight for every row. target: a frame with column text."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(partial(_by_document, n=draw.n), BY_DOCUMENT)
    with scratch(dictionary(rows, draw)) as source:
        gain = gains(source, dictionary(pick(target, "text"), draw), draw)
        known = source.join(F.broadcast(gain), "bucket").select(F.col("feature").alias("its"), "n", "gain")
        often = (F.octet_length("its") <= SHORT) & (_step(F.col("n")) >= _least_step(known, frequent))
        hot = F.broadcast(known.filter(often).select("its", "gain"))
        keys = ["doc_id", "key"]

        def summed(found: DataFrame) -> DataFrame:
            return found.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("gain", F.lit(0))).alias("total"), F.sum("words").alias("words"), F.sum("copies").alias("copies"))

        if known.filter(~often).isEmpty():
            found = summed(counts.join(hot, counts["feature"] == hot["its"], "left"))
        else:
            # one pass over the texts: what the frequent features don't know goes on to the rest
            here = counts.join(hot, counts["feature"] == hot["its"], "left").withColumn("rest", F.col("its").isNull() & F.col("feature").isNotNull())
            folded = here.groupBy(*keys, F.when(F.col("rest"), F.col("feature")).alias("feature")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("gain", F.lit(0))).alias("total"), F.sum("words").alias("words"), F.sum("copies").alias("copies"))
            with scratch(folded) as folded:
                rare = known.filter(~often).select("its", "gain")
                far = folded.filter("feature is not null").join(rare, F.col("feature") == F.col("its")).select(*keys, "n", "gain", "words", "copies")
                near = folded.filter("feature is null").select(*keys, "n", "total", "words", "copies")
                sums = far.select(*keys, "n", (F.col("n") * F.col("gain")).alias("total"), "words", "copies").unionByName(near)
                return cut(_weighed(sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "words", "copies")])))
        return cut(_weighed(found))


def _weighed(found: DataFrame) -> DataFrame:
    """A row for each copy. Sums over equal rows are sums of one, times their number."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    mean = F.expr("case when n = 0 then 0L else total div n - if(total % n < 0, 1L, 0L) end")
    return each.select("doc_id", "key", F.expr("words div copies").alias("n_words"), F.expr("n div copies").alias("n_features"), mean.alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) for every row."""
    name = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = weights(docs, target, draw, frequent).withColumn("score", F.col("weight") + noise)
    fit = scored.filter(F.col("n_words") >= draw.least_words)
    quota = draw.percent * fit.count() // 100
    order = fit.select((-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n_features", "weight", "score")
    ranked = dense_index(order, ["down", "none", "doc_id", "key"], "place")
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < quota, F.col("place") + 1).alias("rank"))
    rest = scored.filter(F.col("n_words") < draw.least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
