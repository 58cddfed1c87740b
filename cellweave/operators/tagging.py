"""Barcodes out of FASTQ reads, and onto alignments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import between, pieces
from ..shared import written_once
from .barcodes import correct


@dataclass(frozen=True)
class Embedded:
    """A barcode at [start, end) of a read, and the tags of its sequence and its quality."""

    start: int
    end: int
    sequence_tag: str
    quality_tag: str

    def __post_init__(self) -> None:
        if self.start < 0 or self.end <= self.start:
            raise ValueError("a barcode starts at 0 or more and is 1 long at least")


#: The layout of version 2 of the common droplet kit.
TEN_X_V2 = {"cell": Embedded(0, 16, "CR", "CY"), "molecule": Embedded(16, 26, "UR", "UY"), "sample": Embedded(0, 8, "SR", "SY")}


def layout(cell: tuple[int, int] | None = None, molecule: tuple[int, int] | None = None, sample: tuple[int, int] | None = None, has_index: bool = False) -> dict[str, Embedded]:
    """Barcodes by (start, length), checked: a molecule's starts after the cell's end, a sample's needs the index read."""
    tags = {"cell": ("CR", "CY"), "molecule": ("UR", "UY"), "sample": ("SR", "SY")}
    out = {}
    for kind, where in {"cell": cell, "molecule": molecule, "sample": sample}.items():
        if where is not None:
            start, length = where
            if length is None or start is None:
                raise ValueError(f"{kind} barcode: start and length go together")
            if length < 1:
                raise ValueError(f"{kind} barcode: length must be 1 or more")
            out[kind] = Embedded(start, start + length, *tags[kind])
    if not out:
        raise ValueError("no barcode is asked for")
    if "cell" in out and "molecule" in out and out["molecule"].start < out["cell"].end:
        raise ValueError("the molecule barcode must start after the cell barcode's end")
    if "sample" in out and not has_index:
        raise ValueError("a sample barcode needs the index read")
    return out


def extract(reads: DataFrame, barcodes: Sequence[Embedded]) -> DataFrame:
    """file, rec and each barcode's sequence and quality."""
    if not isinstance(barcodes, (list, tuple)):
        raise TypeError("barcodes must be a list or tuple")
    found = [c for b in barcodes for c in (between(F.col("sequence"), b.start, b.end).alias(b.sequence_tag), between(F.col("quality"), b.start, b.end).alias(b.quality_tag))]
    return reads.select("file", "rec", *found)


def extract_corrected(reads: DataFrame, cell: Embedded, whitelist: DataFrame, others: Sequence[Embedded] = ()) -> DataFrame:
    """extract(), and CB where the cell barcode is within one substitution of a whitelisted one."""
    if not isinstance(others, (list, tuple)):
        raise TypeError("others must be a list or tuple")
    return correct(extract(reads, [cell, *others]), whitelist, cell.sequence_tag, "CB")


def extract_structure(reads: DataFrame, pattern: str) -> DataFrame:
    """file, rec, CR, CY, UR, UY by a read structure; reads of fewer than 4 bases are left out."""
    kept = reads.filter(F.length("sequence") >= 4)
    tags = {"CR": ("sequence", "C"), "CY": ("quality", "C"), "UR": ("sequence", "M"), "UY": ("quality", "M")}
    return kept.select("file", "rec", *[pieces(F.col(c), pattern, kind).alias(tag) for tag, (c, kind) in tags.items()])


def unmapped_records(reads: DataFrame, tags: DataFrame, group: str = "A") -> DataFrame:
    """Unaligned records of reads with the tags of the same (file, rec)."""
    named = reads.select("file", "rec", F.regexp_extract("name", r"^@?(\S+)", 1).alias("qname"), F.lit(4).alias("flag"), F.col("sequence").alias("seq"), F.col("quality"), F.lit(group).alias("RG"))
    return named.join(tags, ["file", "rec"])


def in_step(reads: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reads of files in step (read with keep_bad) without the ordinals at which any of them is bad; and the bad ones: read, file, rec, name, fault.

    Bad records are written to the checkpoint folder once, so that every file is read for them once; where they are few, those of the other
    files are looked up without a shuffle of the good ones.
    """
    bad = written_once(reduce(DataFrame.unionByName, [r.filter("bad is not null").select(F.lit(k).alias("read"), "file", "rec", "name", F.col("bad").alias("fault")) for k, r in reads.items()]))
    gone = bad.select("rec").distinct()
    return {k: r.join(gone, "rec", "left_anti").drop("bad") for k, r in reads.items()}, bad


def bad_counts(bad: DataFrame) -> DataFrame:
    """read, file, fault, n."""
    return bad.groupBy("read", "file", "fault").agg(F.count(F.lit(1)).alias("n"))


def zipped(*frames: DataFrame, on: Sequence[str] = ("rec",), indices: Sequence[int] | None = None) -> DataFrame:
    """Rows side by side by (dense) ordinal, as far as the shortest goes; a later frame's column replaces an earlier one's.

    indices: only these ordinals.
    """

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.drop(*[c for c in right.columns if c not in on]).join(right, list(on))

    out = reduce(beside, frames)
    return out.filter(F.col("rec").isin(list(indices))) if indices else out


def attach(alignments: DataFrame, *tags: DataFrame) -> DataFrame:
    """Alignments with the tags of the reads of the same ordinal. Ordinals are dense, over all files of each."""
    return zipped(alignments, *[t.drop("file") for t in tags])


def attach_barcodes(alignments: DataFrame, r1: DataFrame, barcodes: dict[str, Embedded], i1: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Cell and molecule barcodes of r1 and sample barcodes of i1 as tags of the alignments."""
    on_r1 = [b for k, b in barcodes.items() if k != "sample"]
    cell = barcodes.get("cell")
    if whitelist is not None and cell is None:
        raise ValueError("a whitelist needs a cell barcode")
    found = []
    if on_r1:
        found.append(extract(r1, on_r1) if whitelist is None else extract_corrected(r1, cell, whitelist, [b for b in on_r1 if b is not cell]))
    if "sample" in barcodes:
        if i1 is None:
            raise ValueError("a sample barcode needs the index read")
        found.append(extract(i1, [barcodes["sample"]]))
    return attach(alignments, *found)


def correct_alignments(alignments: DataFrame, whitelist: DataFrame) -> DataFrame:
    """CB from CR; the raw barcode where it can't be corrected."""
    return correct(alignments, whitelist, "CR", "CB", fall_back=True)


def downsampled_read(spacer: str = "CTTCAGCGTTCCCGAGAG") -> list:
    """Sequence and quality columns of a rebuilt read 1: 8 of the barcode, a spacer, 6 more, the molecule, T."""
    mark = F.lit("F" * len(spacer))
    return [
        F.concat(F.substring("CR", 1, 8), F.lit(spacer), F.substring("CR", 9, 6), F.col("UR"), F.lit("T")).alias("sequence"),
        F.concat(F.substring("CY", 1, 8), mark, F.substring("CY", 9, 6), F.col("UY"), F.lit("F")).alias("quality"),
    ]
