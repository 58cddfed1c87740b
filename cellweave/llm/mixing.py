"""Temperature mixing of sources, DataFrame functions only.

A source with the share p of all tokens (words) gets the weight p**a / sum(p**a). The exponent a is
the largest in [0, 1] whose weights have at least the target entropy (a part of the logarithm of the number
of sources), raised if need be until no source is repeated more than max_epochs times. The
weights become token budgets; each source is dealt out in blocks, all its documents once in a block's own
permutation, until its budget is used: whole blocks first, then the documents of one more
permutation as far as the rest of the budget reaches.

Defined cases: a null source is a source of its own; a null or empty text has no tokens; a source
without tokens has weight 0 and is dealt out once; rows with equal doc_id share their place in a
permutation, and come in or stay out together; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_groups, packed, pick, split_words, unpacked

#: Keys have 60 bits; their top 12 bits make the buckets that are summed before rows are ordered.
KEY_BITS, BUCKET_BITS = 60, 12
GRID, ROUNDS = 16, 10


@dataclass(frozen=True)
class Mix:
    """budget None: the least budget that deals out every document at least once."""

    target_entropy: float = 0.99
    max_epochs: float = 2.0
    budget: int | None = None
    seed: int = 7


def n_tokens(text: Column) -> Column:
    return F.size(split_words(F.coalesce(text, F.lit("")))).cast("long")


def place(doc_id: Column, block: Column, seed: int) -> Column:
    """A document's 60-bit key in a block's permutation of its source."""
    named = F.concat_ws("-", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def exponent(sources: DataFrame, mix: Mix) -> dict:
    """The exponent and sums that the weights need: each round tries GRID exponents in one pass over the sources."""
    full = sources.filter("tokens > 0")
    sums = full.agg(F.sum("tokens").cast("double").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not sums["n"]:
        return {"a": 1.0, "total": 0.0, "power": 1.0, "budget": 0.0}
    share = F.col("tokens") / F.lit(sums["total"])

    def tried(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and sum of powers of each."""
        row = full.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"s{i}") for i, a in enumerate(exponents)], *[F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}") for i, a in enumerate(exponents)]).first()
        return [(math.log(row[f"s{i}"]) - a * row[f"l{i}"] / row[f"s{i}"], row[f"s{i}"]) for i, a in enumerate(exponents)]

    def budget(a: float, power: float) -> float:
        if mix.budget is not None:
            return float(mix.budget)
        return max(x * power / (x / sums["total"]) ** a for x in (sums["least"], sums["most"]))

    def epochs(a: float, power: float) -> float:
        return max((x / sums["total"]) ** a / power * budget(a, power) / x for x in (sums["least"], sums["most"]))

    def turn(good) -> tuple[float, float]:
        """The last exponent of 0 to 1 where good(a, entropy, power) is as at 0, and the first (by GRID**-ROUNDS) where it isn't."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            fits = [good(a, *x) for a, x in zip(grid, tried(grid), strict=True)]
            if len(set(fits)) == 1:
                return high, high
            k = fits.index(not fits[0])
            low, high = grid[k - 1], grid[k]
        return low, high

    want = mix.target_entropy * math.log(sums["n"])
    a, _ = turn(lambda a, entropy, power: entropy >= want - 1e-12)
    ((_, power),) = tried([a])
    if epochs(a, power) > mix.max_epochs:
        _, a = turn(lambda a, entropy, power: epochs(a, power) > mix.max_epochs)
        ((_, power),) = tried([a])
    return {"a": a, "total": sums["total"], "power": power, "budget": budget(a, power)}


def weights(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """One row per source: source, tokens, docs, weight, budget, epochs (whole blocks), last_key.

    A document is in the last, partial block if its key there is at most last_key.
    """
    rows = pick(docs, "doc_id", "text", source).withColumnRenamed(source, "source")
    rows = cut(rows.select("source", "doc_id", n_tokens(F.col("text")).alias("tokens")))
    sources = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    found = exponent(sources, mix)
    share = F.col("tokens") / F.lit(found["total"] or 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(found["a"])) / F.lit(found["power"])).otherwise(F.lit(0.0))
    table = sources.select("source", "tokens", "docs", weight.alias("weight"))
    table = table.withColumn("budget", F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(found["budget"])).cast("long")).otherwise(F.lit(0).cast("long")))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1))
    table = table.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0).cast("long")))
    table = cut(table)
    keyed = join_groups(rows, table.select("source", "epochs", "rest"), "source")
    keyed = keyed.withColumn("key", place(F.col("doc_id"), F.col("epochs"), mix.seed)).withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("tokens").over(over))  # 4096 rows a source at most
    torn = sums.filter("upto > rest and upto - tokens <= rest").select(F.col("source").alias("of"), F.col("bucket").alias("torn"), (F.col("upto") - F.col("tokens")).alias("before"))
    torn = cut(torn.groupBy("of").agg(F.min_by(F.struct("torn", "before"), "torn").alias("x")).select("of", "x.torn", "x.before"))
    inside = keyed.join(torn, keyed["source"].eqNullSafe(torn["of"]) & (keyed["bucket"] == torn["torn"]))
    peers = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(peers)).filter("upto <= rest")
    ends = inside.groupBy(F.col("source").alias("its")).agg(F.max("key").alias("end"))
    limits = torn.join(ends, torn["of"].eqNullSafe(ends["its"]), "left").select("of", F.coalesce("end", F.shiftleft("torn", KEY_BITS - BUCKET_BITS) - 1).alias("last_key"))
    whole = table.join(limits, table["source"].eqNullSafe(limits["of"]), "left").drop("of")
    # no torn bucket: the rest is 0 or nothing is over it
    none = F.when(F.col("rest") > 0, F.lit((1 << KEY_BITS) - 1)).otherwise(F.lit(-1).cast("long"))
    partial = F.when(F.col("rest") > 0, F.coalesce("last_key", none)).otherwise(F.lit(-1).cast("long"))
    return whole.withColumn("last_key", partial.cast("long"))


def dealt(rows: DataFrame, table: DataFrame, mix: Mix) -> DataFrame:
    """rows (with doc_id and source) once for each block they are in: + weight, block, key."""
    both = join_groups(rows, cut(table.select("source", "weight", "epochs", "last_key")), "source")
    extra = (place(F.col("doc_id"), F.col("epochs"), mix.seed) <= F.col("last_key")).cast("long")
    copies = F.col("epochs") + extra
    blocks = F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>")))
    both = both.withColumn("block", blocks).drop("epochs", "last_key")
    return both.withColumn("key", place(F.col("doc_id"), F.col("block"), mix.seed))


def mixture(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, weight, block, key: the training order of a source is by block, then key."""
    rows = pick(docs, "doc_id", "text", source).withColumnRenamed(source, "source")
    rows = rows.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    return dealt(rows, weights(docs, mix, source), mix)


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """The documents with all their columns, once for each block they are in."""
    whole = packed(docs, "doc_id", source).withColumnRenamed(source, "source")
    return unpacked(dealt(whole, weights(docs, mix, source), mix), docs.columns)
