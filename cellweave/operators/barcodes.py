"""Barcode sets: correction against a whitelist, composition, distances, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import THREE_BIT_LONGEST, decode_three_bit, decode_two_bit, encode_three_bit, encode_two_bit, entropy4, hamming, hamming_encoded, letters

ALPHABET = "ACGTN"
#: A whitelist's variants are broadcast up to this many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def last_lines(whitelist: DataFrame) -> DataFrame:
    """barcode, line_no: each barcode once. Only the last line of one that comes again can win."""
    return whitelist.filter("barcode is not null").groupBy("barcode").agg(F.max("line_no").alias("line_no"))


def most_variants(whitelist: DataFrame) -> int:
    """A bound of the rows of variants(): each base of a barcode can become one of the others of the alphabet, or it stays; of letters of the alphabet there are only so many texts of a length."""
    n = F.length("barcode")
    sizes = last_lines(whitelist).groupBy(n.alias("n"), F.col("barcode").rlike(f"^[{ALPHABET}]*$").alias("plain")).agg(F.count(F.lit(1)).alias("barcodes"))
    each = F.col("barcodes") * (1 + F.col("n") * len(ALPHABET))
    texts = F.when(F.col("plain"), F.pow(F.lit(float(len(ALPHABET))), F.col("n")))
    return int(sizes.agg(F.sum(F.least(each.cast("double"), texts)).alias("most")).first()["most"] or 0)


def variants(whitelist: DataFrame) -> DataFrame:
    """variant, corrected: every text within one substitution of a barcode. whitelist: barcode, line_no.

    A variant of several barcodes is the last one's, even where it is itself a barcode.
    """
    bc = F.col("barcode")
    changed = F.flatten(F.transform(F.sequence(F.lit(1), F.length(bc)), lambda i: F.transform(F.array(*map(F.lit, ALPHABET)), lambda b: F.overlay(bc, b, i, F.lit(1)))))
    every = F.array_union(F.array(bc), F.when(F.length(bc) > 0, changed).otherwise(F.array().cast("array<string>")))
    return last_lines(whitelist).select("barcode", "line_no", F.explode(every).alias("variant")).groupBy("variant").agg(F.max_by("barcode", "line_no").alias("corrected"))


#: Letters that a three-bit code holds, and how many of them.
CODED = f"^[{ALPHABET}]{{1,{THREE_BIT_LONGEST}}}$"


def _halves(barcode: Column) -> Column:
    """Both halves of a barcode, as array of structs: which half, the length of the whole, the half."""
    n = F.length(barcode)
    first = (n / 2).cast("int")
    part = lambda k, text: F.struct(F.lit(k).alias("half"), n.alias("length"), text.alias("part"))
    return F.array(part(0, F.substring(barcode, F.lit(1), first)), part(1, F.substring(barcode, first + 1, n - first)))


def nearest(raws: DataFrame, whitelist: DataFrame) -> DataFrame:
    """raw, corrected: of each distinct raw barcode (column raw) the last whitelisted one within a substitution by a letter of ALPHABET.

    Of two barcodes within one substitution one half is equal: they are joined on halves and then compared, as numbers where all
    their letters have a code. A whitelist is indexed by two rows a barcode, whatever its length.
    """
    known = last_lines(whitelist).withColumn("code", F.when(F.col("barcode").rlike(CODED), encode_three_bit(F.col("barcode"))))
    wanted = raws.select("raw").filter("raw is not null").distinct().withColumn("raw_code", F.when(F.col("raw").rlike(CODED), encode_three_bit(F.col("raw"))))
    left = wanted.select("raw", "raw_code", F.explode(_halves(F.col("raw"))).alias("at")).select("raw", "raw_code", "at.*")
    right = known.select("barcode", "line_no", "code", F.explode(_halves(F.col("barcode"))).alias("its")).select("barcode", "line_no", "code", *[F.col(f"its.{c}").alias(f"its_{c}") for c in ("half", "length", "part")])
    same = (F.col("half") == F.col("its_half")) & (F.col("length") == F.col("its_length")) & (F.col("part") == F.col("its_part"))
    coded = left.filter("raw_code is not null").join(right.filter("code is not null"), same).filter(hamming_encoded(F.col("raw_code"), F.col("code"), 3) <= 1)
    # a letter that has no code can stay, but nothing can become it
    odd = left.join(right, same & (F.col("raw_code").isNull() | F.col("code").isNull()))
    changed = F.filter(F.zip_with(letters(F.col("raw")), letters(F.col("barcode")), lambda x, y: F.when(x != y, x)), lambda x: x.isNotNull())
    odd = odd.filter((F.size(changed) == 0) | (F.size(changed) == 1) & F.get(changed, F.lit(0)).isin(*ALPHABET))
    found = coded.select("raw", "barcode", "line_no").unionByName(odd.select("raw", "barcode", "line_no"))
    return found.groupBy("raw").agg(F.max_by("barcode", "line_no").alias("corrected"))


def correct(rows: DataFrame, whitelist: DataFrame, raw: str = "CR", into: str = "CB", fall_back: bool = False, most: int | None = None) -> DataFrame:
    """rows with the whitelisted barcode of column raw; where there is none: null, or with fall_back the raw one.

    A whitelist of few variants (most, or BROADCAST_ROWS, at most) is looked up by them, broadcast; a larger one by halves of the distinct raw barcodes.
    """
    known = F.broadcast(variants(whitelist)) if most_variants(whitelist) <= (BROADCAST_ROWS if most is None else most) else nearest(rows.select(F.col(raw).alias("raw")), whitelist).withColumnRenamed("raw", "variant")
    joined = rows.drop(into).join(known, rows[raw] == known["variant"], "left").drop("variant")
    return joined.withColumn(into, F.coalesce("corrected", raw) if fall_back else F.col("corrected")).drop("corrected")


def correction_tally(corrected: DataFrame, *by: str, raw: str = "CR", into: str = "CB") -> DataFrame:
    """Per group: reads whose barcode was right, was corrected, couldn't be, and the share of the last in percent."""
    n = F.count(F.lit(1))
    bad = F.count_if(F.col(into).isNull())
    return corrected.groupBy(*by).agg(
        n.alias("n_reads"),
        F.count_if(F.col(into) == F.col(raw)).alias("n_correct"),
        F.count_if(F.col(into) != F.col(raw)).alias("n_corrected"),
        bad.alias("n_uncorrectable"),
        F.try_divide(bad * 100.0, n).alias("pct_uncorrectable"),
    )


def multiset(rows: DataFrame, barcode: str = "barcode") -> DataFrame:
    """barcode, n."""
    return rows.groupBy(F.col(barcode).alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


def counts_descending(rows: DataFrame, barcode: str) -> DataFrame:
    """barcode, n: the most frequent first, ties by name."""
    return multiset(rows.filter(F.col(barcode).isNotNull()), barcode).orderBy(F.desc("n"), "barcode")


def _by_place(rows: DataFrame, barcode: str, bases: str, base: Column) -> DataFrame:
    each = rows.select(F.posexplode(letters(F.col(barcode))).alias("pos", "letter"))
    return each.select("pos", base.alias("base")).groupBy("pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in bases])


def base_frequency(rows: DataFrame, barcode: str = "barcode", weighted: bool = False) -> DataFrame:
    """pos (from 0), A, C, T, G: how many of the distinct barcodes have the base there."""
    if weighted:
        raise NotImplementedError("weighted base frequencies")
    return _by_place(rows.select(barcode).distinct(), barcode, "ACTG", F.col("letter"))


def effective_diversity(rows: DataFrame, barcode: str = "barcode") -> DataFrame:
    """pos, diversity: entropy to base 4 of the bases at each place; 1 where all are as frequent."""
    counts = base_frequency(rows, barcode)
    total = sum((F.col(b) for b in "ACTG"), F.lit(0))
    return counts.select("pos", entropy4(*[F.try_divide(F.col(b), total) for b in "ACTG"]).alias("diversity"))


def position_weights(rows: DataFrame, sequence: str) -> DataFrame:
    """position (from 1), A, C, G, T, N: reads with the base there; other characters count nowhere."""
    counts = _by_place(rows, sequence, "ACGTN", F.upper("letter"))
    return counts.select((F.col("pos") + 1).alias("position"), *"ACGTN")


#: Barcodes of a tile, about: all pairs are compared tile by tile.
TILE = 4096
#: Barcodes that are compared as numbers of two bits a letter.
PLAIN = "^[ACGT]{1,31}$"


#: Tasks that compare pairs of tiles, at most.
MOST_TASKS = 2000


def _tile_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, n of pairs of tiles: i, j and two lists of two-bit codes of distinct barcodes. Of a tile with itself each pair counts once."""
    found = np.zeros(33, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            i, j, x, y = (batch.column(c)[k] for c in range(4))
            x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
            own = np.zeros(33, np.int64)
            for at in range(0, len(x), 64):
                differing = x[at : at + 64, None] ^ y[None, :]
                differing = (differing | differing >> np.uint64(1)) & np.uint64(0x5555555555555555)
                own += np.bincount(np.bitwise_count(differing).ravel(), minlength=33)
            if i.as_py() == j.as_py():
                own[0] -= len(x)
                own //= 2
            found += own
    d = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(found[d])], names=["d", "n"])


def distance_counts(rows: DataFrame, barcode: str = "barcode", tile: int = TILE) -> DataFrame:
    """d, n: how many pairs of distinct barcodes of one length are at each distance.

    Barcodes are dealt out to tiles by hash, and every two tiles, and each with itself, meet in a row of their own: all pairs are
    there once, by many tasks, and are counted where they are made. Those of other letters than A, C, G, T are compared as text.
    """
    one = rows.select(F.col(barcode).alias("a")).filter("a is not null").distinct()
    tiles = max(1, -(-one.count() // tile))
    one = one.withColumns({"length": F.length("a"), "code": F.when(F.col("a").rlike(PLAIN), encode_two_bit(F.col("a"))), "home": F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int")})
    left = one.select("a", "length", F.col("code").alias("x"), F.col("home").alias("i"), F.explode(F.sequence("home", F.lit(tiles - 1))).alias("j"))
    right = one.select(F.col("a").alias("b"), F.col("length").alias("its"), F.col("code").alias("y"), F.explode(F.sequence(F.lit(0), F.col("home"))).alias("p"), F.col("home").alias("q"))
    met = (F.col("i") == F.col("p")) & (F.col("j") == F.col("q")) & (F.col("length") == F.col("its")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))

    def counted(pairs: DataFrame, d: Column) -> DataFrame:
        return pairs.groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n"))

    each = one.filter("code is not null").groupBy("length", F.col("home").alias("i")).agg(F.collect_list("code").alias("x"))
    its = each.select("length", F.col("i").alias("j"), F.col("x").alias("y"))
    pairs = each.withColumn("j", F.explode(F.sequence("i", F.lit(tiles - 1)))).join(its, ["length", "j"]).select("i", "j", "x", "y")
    # so many partitions, whatever their bytes: a pair of tiles is little to read and much to compare
    found = pairs.repartition(min(tiles * (tiles + 1) // 2, MOST_TASKS)).mapInArrow(_tile_distances, "d int, n long")
    if not one.filter("code is null").isEmpty():
        other = left.join(right, met & (F.col("x").isNull() | F.col("y").isNull()))
        found = found.unionByName(counted(other, hamming(F.col("a"), F.col("b"))))
    return found.groupBy("d").agg(F.sum("n").alias("n"))


def hamming_summary(rows: DataFrame, barcode: str = "barcode") -> DataFrame:
    """minimum, 25th percentile, median, 75th percentile, maximum and average distance of all pairs of distinct barcodes of one length.

    All pairs are the definition: meant for whitelists. Distances are counted by value before they are ranked.
    """
    counts = distance_counts(rows, barcode)
    q = [F.percentile("d", F.lit(x), F.col("n")) for x in (0.25, 0.5, 0.75)]
    return counts.agg(
        F.min("d").cast("double").alias("minimum"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"),
        F.max("d").cast("double").alias("maximum"), F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("average"),
    )


def partition_overlap(rows: DataFrame, barcode: str = "CB", part: str = "file") -> DataFrame:
    """Barcodes that are in several parts, and in how many: none, if the parts were split by barcode."""
    return rows.filter(F.col(barcode).isNotNull()).groupBy(barcode).agg(F.count_distinct(part).alias("parts")).filter("parts > 1")


class Barcodes:
    """Barcodes of one length and how often each is there, looked up like a mapping; each look is a job over the rows."""

    def __init__(self, rows: DataFrame, length: int):
        """rows: barcode, n."""
        if not isinstance(length, int) or isinstance(length, bool) or length < 1:
            raise ValueError("a barcode's length is a whole number of 1 or more")
        self.rows, self.length = rows.select("barcode", F.col("n").cast("long").alias("n")), length

    @classmethod
    def from_rows(cls, rows: DataFrame, length: int, barcode: str = "barcode") -> Barcodes:
        """Of rows of barcodes, repeated or not; null is none."""
        return cls(multiset(rows.filter(F.col(barcode).isNotNull()), barcode), length)

    @classmethod
    def from_whitelist(cls, spark: SparkSession, path: str, length: int) -> Barcodes:
        """Of a file of one barcode a line; a line that comes again counts again."""
        from ..sources import readers

        return cls.from_rows(readers.whitelist(spark, path), length)

    @classmethod
    def from_encoded(cls, rows: DataFrame, length: int, code: str = "code", bits: int = 2) -> Barcodes:
        """Of rows of encoded barcodes of 2 or 3 bits a base."""
        if bits not in (2, 3):
            raise ValueError("2 or 3 bits a base")
        # codes are counted first, so that each distinct one is decoded once
        counted = multiset(rows.filter(F.col(code).isNotNull()), code)
        text = decode_two_bit(F.col("barcode"), length) if bits == 2 else decode_three_bit(F.col("barcode"))
        return cls(counted.groupBy(text.alias("barcode")).agg(F.sum("n").alias("n")), length)

    def __contains__(self, barcode: str) -> bool:
        return not self.rows.filter(F.col("barcode") == barcode).isEmpty()

    def __getitem__(self, barcode: str) -> int:
        found = self.rows.filter(F.col("barcode") == barcode).agg(F.sum("n").alias("n")).first()["n"]
        if found is None:
            raise KeyError(barcode)
        return found

    def __len__(self) -> int:
        return self.rows.select("barcode").distinct().count()

    def __iter__(self) -> Iterator[str]:
        return (r["barcode"] for r in self.rows.select("barcode").distinct().toLocalIterator())

    def base_frequency(self) -> DataFrame:
        return base_frequency(self.rows)

    def effective_diversity(self) -> DataFrame:
        return effective_diversity(self.rows)

    def hamming_summary(self) -> DataFrame:
        return hamming_summary(self.rows)
