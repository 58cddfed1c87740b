"""Writers: metrics tables, tagged and binned alignments, FASTQ shards, sorted text, matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import dense_index
from ..operators.tagging import downsampled_read
from .archives import write_archive
from .formats import register
from .raw import located


def csv_name(path: str) -> str:
    """A metrics file's name always ends in .csv or .csv.gz."""
    return path if path.endswith((".csv", ".csv.gz")) else path.removesuffix(".gz") + ".csv.gz"


def metrics_csv(table: DataFrame, path: str, compress: bool = True) -> None:
    """A folder of CSV parts: the entity in a first column without a name, None where it is null; nan for missing numbers."""
    entity = table.columns[0]
    shown = table.select(F.coalesce(F.col(entity), F.lit("None")).alias(" "), *[F.when(F.col(c).isNull(), "nan").otherwise(F.col(c).cast("string")).alias(c) for c in table.columns[1:]])
    shown.write.mode("overwrite").csv(path, header=True, compression="gzip" if compress else "none", emptyValue="")


def metrics_file(table: DataFrame, path: str) -> str:
    """One CSV file, rows streamed through the driver a partition at a time. For tables of entities."""
    import gzip

    path = csv_name(path)
    system, inner = located(path)
    with system.open_output_stream(inner, compression=None) as raw:
        out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if path.endswith(".gz") else raw
        out.write((",".join(["", *table.columns[1:]]) + "\n").encode())
        for row in table.toLocalIterator():
            cells = ["None" if row[0] is None else str(row[0]), *["nan" if v is None else format(v, ".10g") if isinstance(v, float) else str(v) for v in row[1:]]]
            out.write((",".join(cells) + "\n").encode())
        if out is not raw:
            out.close()
    return path


def alignments(rows: DataFrame, path: str, header: list[str], kind: str = "bam", mode: str = "overwrite", blocks: bool = False) -> None:
    """A folder of SAM or BAM files, one a partition, each with the header. blocks: SAM files compressed as BAM files are (part-*.sam.gz), which are read in splits, too."""
    register(rows.sparkSession)
    rows.write.format(kind).mode(mode).option("header", json.dumps(header)).option("blocks", str(blocks).lower()).save(path)


def single_bam(rows: DataFrame, path: str, header: list[str]) -> None:
    """One BAM file of all rows, partition after partition (a sorted frame stays sorted), and its index. An earlier file is replaced.

    Tasks compress; the commit, one process, only copies their blocks.
    """
    register(rows.sparkSession)
    rows.write.format("bam").mode("overwrite").option("header", json.dumps(header)).option("single", "true").save(path)


def shard_header(sample: str) -> list[str]:
    return ["@HD\tVN:1.6\tSO:unsorted", f"@RG\tID:A\tSM:{sample}"]


def binned_alignments(rows: DataFrame, path: str, n: int, header: list[str], by: str = "bin", kind: str = "bam", files: int = 1) -> None:
    """One file per bin, part-<bin>: rows of bin k (from 0 to n - 1) are in partition k, in the order of rec. A bin without rows is a file of the header.

    files: that many for a bin, for bins that are large: rows of bin k are dealt out by hash to part-<k * files> and those that follow, each in the order of rec.
    """
    number = F.col(by) if files == 1 else F.col(by) * files + F.pmod(F.xxhash64("rec"), F.lit(files))
    dealt = rows.repartitionById(n * files, number.cast("int")).sortWithinPartitions(*[c for c in ("file", "rec") if c in rows.columns]).drop(by)
    alignments(dealt, path, header, kind)


def fastq_text(name: str, sequence: str, quality: str):  # noqa: ANN201
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.expr(sequence), F.lit("+"), F.expr(quality))


def fastq_shards(reads: DataFrame, path: str, shard: str = "shard") -> None:
    """R1 (barcode and molecule) and R2 (the read) as gzipped text, a folder per shard, records of both in one order."""
    dealt = reads.repartition(shard).sortWithinPartitions(shard, "file", "rec")
    r1 = fastq_text("qname", "CR || UR", "CY || UY")
    r2 = fastq_text("qname", "seq", "quality")
    for name, text in (("R1", r1), ("R2", r2)):
        dealt.select(shard, text.alias("value")).write.mode("overwrite").partitionBy(shard).text(f"{path}/{name}", compression="gzip")


def downsampled_fastq(reads: DataFrame, path: str) -> None:
    """Reads with a corrected barcode only, read 1 rebuilt."""
    kept = reads.filter(F.col("CB").isNotNull())
    sequence, quality = downsampled_read()
    r1 = kept.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname")), sequence, F.lit("+"), quality).alias("value"))
    r1.write.mode("overwrite").text(f"{path}/R1", compression="gzip")
    kept.select(fastq_text("qname", "seq", "quality").alias("value")).write.mode("overwrite").text(f"{path}/R2", compression="gzip")


def sorted_text(sorted_rows: DataFrame, path: str) -> None:
    """Tab-separated rows without a header, in order over the parts."""
    sorted_rows.write.mode("overwrite").csv(path, sep="\t", nullValue="")


def barcode_tables(rows: DataFrame, path: str) -> None:
    """Tab-separated tables, a folder."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)


def count_tables(counts: DataFrame, path: str) -> None:
    """Parquet folders counts (cell_index, gene_index, n), cells and genes: the form that scales."""
    cells = dense_index(counts.select("cell").distinct(), ["cell"], "cell_index")
    genes = dense_index(counts.select("gene").distinct(), ["gene"], "gene_index")
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    genes.write.mode("overwrite").parquet(f"{path}/genes")
    counts.join(cells, "cell").join(genes, "gene").select("cell_index", "gene_index", "n").write.mode("overwrite").parquet(f"{path}/counts")


def count_archive(counts: DataFrame, prefix: str, cells: DataFrame | None = None, genes: DataFrame | None = None) -> None:
    """<prefix>.npz (compressed sparse rows), <prefix>_row_index.npy, <prefix>_col_index.npy.

    cells (cell, cell_index) and genes (gene, gene_index) say what the rows and columns are, also those without counts, so that archives
    of one annotation can be stacked; without them: the names that occur, sorted. Many tasks make the archive's parts. count_tables is the
    form that many tasks can read.
    """
    placed, named = counts.select("cell", "gene", "n"), {}
    for what, given in (("cell", cells), ("gene", genes)):
        names = dense_index(counts.select(what).distinct(), [what], f"{what}_index") if given is None else given.select(what, f"{what}_index")
        named[what] = names
        its = names.withColumnRenamed(what, "its")
        unknown = F.raise_error(F.concat(F.lit(f"unknown {what} "), F.col(what))).cast("long")
        placed = placed.join(its, placed[what] == its["its"], "left").withColumn(f"{what}_index", F.coalesce(f"{what}_index", unknown)).drop("its")
    write_archive(placed, named["cell"], named["gene"], prefix)


def qc_csv(table: DataFrame, path: str) -> str:
    """One CSV file of a pivoted quality table (a row a sample)."""
    path = path if path.endswith(".csv") else path + ".csv"
    system, inner = located(path)
    first, *rest = table.columns
    with system.open_output_stream(inner) as out:
        out.write((",".join(["" if first == "sample" else first, *rest]) + "\n").encode())
        for row in table.toLocalIterator():
            out.write((",".join("" if v is None else str(v) for v in row) + "\n").encode())
    return path
