"""Runs, sorting, subsets and splitting of alignments."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .counts import dense_index, placed

#: With more parts than these a split warns, or fails.
MANY_PARTS, TOO_MANY_PARTS = 500, 1000
TAG_ORDERS = ("BUG", "BGU", "UBG", "UGB", "GUB", "GBU")


class SortError(Exception):
    """Alignments aren't in the order that was claimed."""


#: Ordinals that one task orders: a file's records are dealt out in stretches of so many.
STRETCH = 1 << 20
#: Stretches that one task orders: what they hand on is dealt out in stretches of its own, of which each hands on a row.
HANDED = 1 << 12


def _whole(by: Sequence[str]) -> Column:
    """The file, or other parts, as one key that is never null, though its parts may be: joined by it, rows stay where they are."""
    return F.struct(*by) if by else F.lit(0)


def _joined(inside: DataFrame, handed: DataFrame, value: str, name: str) -> DataFrame:
    """inside (whole, stretch) with name: the value of handed (whole, at) where at is the stretch."""
    its = handed.select(F.col("whole").alias("its_whole"), F.col("at").alias("its_stretch"), F.col(value).alias(name))
    return inside.join(its, (F.col("whole") == F.col("its_whole")) & (F.col("stretch") == F.col("its_stretch")), "left").drop("its_whole", "its_stretch")


def _previous(parts: DataFrame, at: str, widths: Sequence[int]) -> DataFrame:
    """parts (whole, own) with before: own of the part before in the order of at, and stretch. Within stretches of widths[0], these in stretches of widths[1], and so on."""
    if not widths:
        return parts.withColumn("before", F.lag("own").over(Window.partitionBy("whole").orderBy(at)))
    dealt = parts.withColumn("stretch", F.floor(F.col(at) / widths[0]))
    inside = dealt.withColumn("inner", F.lag("own").over(Window.partitionBy("whole", "stretch").orderBy(at)))
    ends = dealt.groupBy("whole", "stretch").agg(F.max_by("own", at).alias("own")).select("whole", F.col("stretch").alias("at"), "own")
    joined = _joined(inside, _previous(ends, "at", widths[1:]), "before", "outer")
    return joined.withColumn("before", F.coalesce("inner", "outer")).drop("inner", "outer")


def with_previous(rows: DataFrame, value: Column, by: Sequence[str] = ("file",), width: int = STRETCH) -> DataFrame:
    """rows with before: the value of the row before in the order of rec (as struct {value}; null for the first one), and stretch.

    Rows are ordered within stretches of ordinals; the last row of each stretch, one row a stretch, is handed on, in stretches again.
    """
    dealt = rows.withColumns({"whole": _whole(by), "own": F.struct(value.alias("value"))})
    return _previous(dealt, "rec", (width, HANDED)).select(*rows.columns, "stretch", "before")


def _starts(parts: DataFrame, widths: Sequence[int]) -> DataFrame:
    """whole, at, start: the run (from 1) that each part begins in. parts: whole, at (their order), first and last (structs of a tag), more (changes of tag inside)."""
    dealt = parts.withColumn("stretch", F.floor(F.col("at") / widths[0]) if widths else F.lit(0))
    order = Window.partitionBy("whole", "stretch").orderBy("at")
    told = dealt.withColumns({"before": F.lag("last").over(order), "past": F.coalesce(F.lag("more").over(order), F.lit(0))})
    # the first part of a stretch: whether it starts a run is known where stretches are ordered
    new = F.when(F.col("before").isNull(), F.lit(0 if widths else 1)).otherwise((F.col("first") != F.col("before")).cast("int"))
    inside = told.withColumn("step", F.col("past") + new)
    inside = inside.withColumn("k", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not widths:
        return inside.select("whole", "at", F.col("k").alias("start"))
    stretches = inside.groupBy("whole", "stretch").agg(F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"), F.max_by(F.col("k") + F.col("more"), "at").alias("more"))
    starts = _starts(stretches.withColumnRenamed("stretch", "at"), widths[1:])
    return _joined(inside, starts, "start", "base").select("whole", "at", (F.col("base") + F.col("k")).alias("start"))


def run_groups(rows: DataFrame, tag: str, by: Sequence[str] = ("file",), drop_null: bool = False, width: int = STRETCH) -> DataFrame:
    """rows with run: the number (from 1) of the stretch of equal tags that a row is in, in the order of rec.

    Null is a tag; a tag that comes again starts another run. Runs are numbered within each file, or other parts (by): changes of tag are
    counted within stretches of ordinals, and these, one row a stretch, within stretches of their own, so that no task orders all of a file's.
    """
    rest = [c for c in rows.columns if c not in by]
    dealt = rows.select(_whole(by).alias("whole"), *rest, F.floor(F.col("rec") / width).alias("stretch"))
    order = Window.partitionBy("whole", "stretch").orderBy("rec")
    new = F.when(F.row_number().over(order) == 1, 0).otherwise((~F.col(tag).eqNullSafe(F.lag(tag).over(order))).cast("long"))
    inside = dealt.withColumn("new", new).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.struct(F.col(tag).alias("value"))
    stretches = inside.groupBy("whole", "stretch").agg(F.min_by(own, "rec").alias("first"), F.max_by(own, "rec").alias("last"), F.sum("new").alias("more"))
    starts = _starts(stretches.withColumnRenamed("stretch", "at"), (HANDED,))
    joined = _joined(inside, starts, "start", "start").withColumn("run", F.col("start") + F.col("k"))
    out = joined.select(*[F.col(f"whole.{c}") if c in by else F.col(c) for c in rows.columns], "run")
    return out.filter(F.col(tag).isNotNull()) if drop_null else out


def run_sizes(rows: DataFrame, tag: str, by: Sequence[str] = ("file",), width: int = STRETCH) -> DataFrame:
    return run_groups(rows, tag, by, width=width).groupBy(*by, "run", tag).agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("first_rec"))


def queries(rows: DataFrame) -> DataFrame:
    """qname, n, first_rec of the alignments of each query."""
    return rows.groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("first_rec"))


def sort_keys(tags: Sequence[str]) -> list[Column]:
    """The tags (a missing one sorts as the empty text), then the query name."""
    if not tags:
        raise ValueError("no tags to sort by")
    return [*[F.coalesce(F.col(t), F.lit("")) for t in tags], F.col("qname")]


def tag_sort(rows: DataFrame, tags: Sequence[str], made: Mapping[str, Column] | None = None) -> DataFrame:
    """made: the columns that alignments have, of the narrow rows that they are made of; only these are shuffled, and columns that aren't sorted by are made behind the sort."""
    if made is None:
        return rows.orderBy(*sort_keys(tags), "rec")
    keys = [*tags, "qname", "rec"]
    dealt = rows.repartitionByRange(*[F.coalesce(made[t], F.lit("")) for t in tags], made["qname"], made["rec"])
    keyed = dealt.select("*", *[made[k].alias(f"_{k}") for k in keys])
    ordered = keyed.sortWithinPartitions(*sort_keys([f"_{t}" for t in tags])[:-1], "_qname", "_rec")
    return ordered.select(*[(F.col(f"_{n}") if n in keys else c).alias(n) for n, c in made.items()])


def tag_places(rows: DataFrame, tags: Sequence[str], name: str = "place", keep: Sequence[str] | None = None, made: Mapping[str, Column] | None = None) -> DataFrame:
    """rows (of distinct rec) with their places, from 0, in the order of tag_sort: by a range sort, no task sees all rows. keep: these columns only. made: as for tag_sort."""
    ordered = tag_sort(rows, tags, made)
    return placed(ordered if keep is None else ordered.select(*keep), name)


def tag_order(code: str, cell: str = "CB", molecule: str = "UB", gene: str = "GE") -> list[str]:
    """Tags of a three-letter order: B(arcode), U(mi), G(ene)."""
    if code not in TAG_ORDERS:
        raise ValueError(f"not one of {TAG_ORDERS}: {code!r}")
    return [{"B": cell, "U": molecule, "G": gene}[c] for c in code]


def out_of_order(rows: DataFrame, tags: Sequence[str], by: Sequence[str] = ("file",), width: int = STRETCH) -> DataFrame:
    """Rows that sort before their predecessor in the file."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(tags))])
    return with_previous(rows, key, by, width).filter(key < F.col("before.value")).drop("before", "stretch")


def verify_sort(rows: DataFrame, tags: Sequence[str], by: Sequence[str] = ("file",)) -> None:
    first = out_of_order(rows, tags, by).limit(1).collect()
    if first:
        raise SortError(f"record {first[0]['rec']} ({first[0]['qname']}) is out of order by {list(tags)}")


def subset(rows: DataFrame, n_specific: int, chromosome: str | int, include_other: int = 0) -> DataFrame:
    """The first n_specific alignments on a chromosome and the first include_other elsewhere."""
    chromosome = str(chromosome)
    bare = chromosome.removeprefix("chr")
    if bare not in {*map(str, range(1, 23)), "M", "MT", "X", "Y"}:
        warnings.warn(f"unusual chromosome {chromosome!r}", stacklevel=2)
    here = rows.filter(F.col("rname") == chromosome).orderBy("rec").limit(n_specific)
    return here.unionByName(rows.filter(~F.col("rname").eqNullSafe(chromosome)).orderBy("rec").limit(include_other)) if include_other else here


def distinct_barcodes(rows: DataFrame, tags: Sequence[str], required: bool = False) -> DataFrame:
    """Distinct values of the first tag there is."""
    from ..functions.sequence import first_tag

    if not tags:
        raise ValueError("no tags")
    return rows.select(first_tag(*[F.col(t) for t in tags], required=required).alias("barcode")).filter(F.col("barcode").isNotNull()).distinct()


def parts_of(megabytes: float, per_part: float = 1000.0) -> int:
    n = max(1, math.ceil(megabytes / per_part))
    if n > TOO_MANY_PARTS:
        raise ValueError(f"{n} parts: more than {TOO_MANY_PARTS}")
    if n > MANY_PARTS:
        warnings.warn(f"{n} parts: more than {MANY_PARTS}", stacklevel=2)
    return n


def split_bins(rows: DataFrame, tags: Sequence[str], n: int, required: bool = True) -> DataFrame:
    """rows with bin: all rows of a barcode are in one of n bins, dealt round robin over the sorted barcodes.

    Rows without any of the tags fail, or with required=False are dropped.
    """
    from ..functions.sequence import first_tag

    key = first_tag(*[F.col(t) for t in tags], required=required)
    kept = rows.withColumn("bin_key", key).filter(F.col("bin_key").isNotNull())
    ranked = dense_index(kept.select("bin_key").distinct(), ["bin_key"], "rank")
    bins = ranked.select(F.col("bin_key").alias("its"), F.pmod("rank", F.lit(n)).cast("int").alias("bin"))
    return kept.join(bins, kept["bin_key"] == bins["its"]).drop("its", "bin_key")


def shard(rows: DataFrame, n: int) -> DataFrame:
    """rows with shard by hash of the cell barcode, the raw one where there is no corrected one."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("CB", "CR")), F.lit(n)).cast("int"))
