"""Readers that give DataFrames: reads, alignments, annotation, whitelists, matrices, metrics."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genes import attributes
from .formats import register
from .splits import SPLIT, dumped, indexed_splits, numbered, splits_of


def _paths(paths: str | list[str]) -> str:
    if isinstance(paths, str):
        paths = [paths]
    if not isinstance(paths, (list, tuple)) or not all(isinstance(p, str) for p in paths):
        raise TypeError("paths must be a path or a list of paths")
    return json.dumps(list(paths))


def read(spark: SparkSession, kind: str, paths: str | list[str], dense: bool = True, columns: list[str] | None = None, split: int = SPLIT, **options: str) -> DataFrame:
    """The records of the files, in their order one stream: rec is a record's ordinal in it.

    dense: ordinals without gaps, for what goes by position (zip, attach, select). Where there are several splits that takes a job at once that
    counts them. Without it, ordinals of a split begin at its number * 2**40: enough for what only needs the order.
    BAM files with an index beside them have their ordinals there.
    columns: those to read; split: the bytes that one task reads, about, where a file can be cut.
    """
    given = json.loads(_paths(paths))
    found = indexed_splits(given, split, options.get("reference")) if kind == "bam" else None
    if found is None:
        found = splits_of(given, split) if "comment" not in options else splits_of(given, 1 << 62)
        if dense and len(found) > 1:
            found = numbered(spark, kind, found, {k: v for k, v in options.items() if k != "reference"})
    reader = register(spark).read.format(kind).options(**options).option("paths", json.dumps(given)).option("splits", dumped(found))
    return (reader.option("columns", json.dumps(list(columns))) if columns else reader).load()


def lines(spark: SparkSession, paths: str | list[str], comment: str | None = None, dense: bool = True) -> DataFrame:
    """file, rec, line: without each file's leading run of comment lines."""
    return read(spark, "lines", paths, dense, **({"comment": comment} if comment else {}))


def select_records(rows: DataFrame, indices: set[int] | DataFrame) -> DataFrame:
    """Rows with these ordinals: a set of a few, or a frame with column rec of any number."""
    if isinstance(indices, DataFrame):
        return rows.join(indices.select("rec"), "rec", "left_semi")
    return rows.filter(F.col("rec").isin(sorted(indices)))


def fastq(spark: SparkSession, paths: str | list[str], dense: bool = True, keep_bad: bool = False, **more) -> DataFrame:  # noqa: ANN003
    """Reads of files. A record whose name doesn't begin with @ is an error.

    keep_bad: it is a row instead, with what is wrong in column bad (null for the others) and an ordinal, as are records
    whose lines don't fit together; reading goes on with the next record that has all four marks.
    """
    return read(spark, "fastq", paths, dense, **({"bad": "keep"} if keep_bad else {}), **more)


def alignments(spark: SparkSession, paths: str | list[str], mode: str | None = None, dense: bool = True, reference: str | None = None, **more) -> DataFrame:  # noqa: ANN003
    """mode: r (SAM) or rb (BAM); by the name's ending if there is none.

    reference: the alignments to this one only, with the ordinals that they have among all. Of BAM files with an index
    only the stretches that have some are read.
    """
    first = paths if isinstance(paths, str) else paths[0]
    kinds = {"r": "sam", "rb": "bam"}
    if mode is not None and mode not in kinds:
        raise ValueError("mode must be r or rb")
    kind = kinds[mode] if mode else next((k for k in ("sam", "bam") if first.endswith(f".{k}")), None)
    if kind is None:
        raise ValueError(f"{first}: neither .sam nor .bam, and no mode")
    if reference is None:
        return read(spark, kind, paths, dense, **more)
    if kind == "bam":
        return read(spark, kind, paths, dense, reference=reference, **more)
    return read(spark, kind, paths, dense, **more).filter(F.col("rname") == reference)


def gtf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """rec, the eight fields, attributes (map)."""
    f = F.split("line", "\t")
    rows = lines(spark, paths, "#").filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    names = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame"]
    return rows.select("rec", *[(f[i].cast("int") if n in ("start", "end") else f[i]).alias(n) for i, n in enumerate(names)], attributes(f[8]).alias("attributes"))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode, line_no: the order decides between barcodes that are one substitution apart."""
    return lines(spark, path).filter("line <> ''").select(F.col("line").alias("barcode"), F.col("rec").alias("line_no"))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """gene: lines that are neither blank nor comments."""
    kept = lines(spark, path).select(F.trim("line").alias("gene"))
    return kept.filter((F.col("gene") != "") & ~F.col("gene").startswith("#"))


def metrics_csv(spark: SparkSession, paths: str | list[str], entity: str) -> DataFrame:
    """A metrics table; its first, unnamed column becomes the entity's. 'nan' is null, as is entity 'None'."""
    raw = spark.read.csv(paths, header=True, nanValue="nan", nullValue="nan")
    names = [entity, *raw.columns[1:]]
    typed = [F.nullif(F.col(f"`{raw.columns[0]}`"), F.lit("None")).alias(entity)]
    for name in names[1:]:
        column = F.col(f"`{name}`")
        double = name.endswith(("_mean", "_variance")) or name.startswith(("reads_per", "fragments_per", "pct_"))
        typed.append(column.cast("double" if double else "long").alias(name))
    return raw.select(*typed)


def matrix_market(spark: SparkSession, path: str, rows: str, columns: str) -> DataFrame:
    """cell, gene, n of a coordinate file and the files of its row and column names."""
    body = lines(spark, path).filter(~F.col("line").startswith("%"))
    size = body.agg(F.min("rec").alias("least"))
    f = F.split(F.trim("line"), r"\s+")
    cells = body.join(F.broadcast(size), F.col("rec") > F.col("least")).select((f[0].cast("long") - 1).alias("i"), (f[1].cast("long") - 1).alias("j"), f[2].cast("long").alias("n"))
    names = [lines(spark, p).select(F.col("rec").alias(k), F.col("line").alias(name)) for p, k, name in ((rows, "i", "cell"), (columns, "j", "gene"))]
    return cells.join(names[0], "i").join(names[1], "j").select("cell", "gene", "n")


def count_archive(spark: SparkSession, prefix: str) -> DataFrame:
    """cell, gene, n of an archive."""
    return archive_entries(spark, prefix).select("cell", "gene", "n")


def archive_entries(spark: SparkSession, prefix: str) -> DataFrame:
    """cell, gene, n, cell_index, gene_index of <prefix>.npz, <prefix>_row_index.npy and <prefix>_col_index.npy.

    The archive is one compressed object, so it is decoded in one task; its entries are dealt out from there.
    """
    files = spark.read.format("binaryFile").load([f"{prefix}.npz", f"{prefix}_row_index.npy", f"{prefix}_col_index.npy"]).select("path", "content").coalesce(1)

    def decode(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        found = {p.rsplit("/", 1)[-1]: bytes(c) for b in batches for p, c in zip(b["path"], b["content"], strict=True)}
        load = lambda end: np.load(io.BytesIO(next(v for k, v in found.items() if k.endswith(end))), allow_pickle=False)
        m, rows, columns = load(".npz"), load("_row_index.npy"), load("_col_index.npy")
        at = np.repeat(np.arange(len(m["indptr"]) - 1), np.diff(m["indptr"]))
        for k in range(0, len(at), 100_000):
            part = slice(k, k + 100_000)
            yield pd.DataFrame({"cell": rows[at[part]].astype(str), "gene": columns[m["indices"][part]].astype(str), "n": m["data"][part].astype("int64"), "cell_index": at[part], "gene_index": m["indices"][part].astype("int64")})

    return files.mapInPandas(decode, "cell string, gene string, n long, cell_index long, gene_index long")


def archive_names(spark: SparkSession, prefix: str, what: str) -> DataFrame:
    """cell and cell_index, or gene and gene_index: what the rows or columns of a count archive are."""
    path = f"{prefix}_{'row' if what == 'cell' else 'col'}_index.npy"

    def decode(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                names = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                yield pd.DataFrame({what: names.astype(str), f"{what}_index": np.arange(len(names))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, f"{what} string, {what}_index long")
