"""Cell by gene counts of distinct molecules, as rows (cell, gene, n)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.sequence import single_gene
from ..schema import INTERGENIC
from ..shared import written_once


def molecules(alignments: DataFrame) -> DataFrame:
    """cell, molecule, gene, first_rec: distinct molecules of queries with exactly one usable gene.

    Cell and molecule barcode are those of a query's first alignment. Alignments without a gene, with several or
    in intergenic places don't count, nor do they disqualify their query.
    """
    usable = F.col("GE").isNotNull() & F.col("XF").isNotNull() & (F.col("XF") != INTERGENIC) & single_gene(F.col("GE"))
    gene = F.when(usable, F.col("GE"))
    queries = alignments.groupBy("qname").agg(F.min(F.struct("rec", "CB", "UB")).alias("first"), F.min(gene).alias("gene"), F.max(gene).alias("other"))
    kept = queries.filter("first.CB is not null and first.UB is not null and gene = other")
    return kept.groupBy(F.col("first.CB").alias("cell"), F.col("first.UB").alias("molecule"), "gene").agg(F.min("first.rec").alias("first_rec"))


def count_matrix(alignments: DataFrame, genes: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """cell, gene, n. genes (gene, gene_index) limits the genes; strict: another gene is an error."""
    counts = molecules(alignments).groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("n"))
    if genes is None:
        return counts
    known = genes.select(F.col("gene").alias("its"), "gene_index")
    joined = counts.join(known, counts["gene"] == known["its"], "left" if strict else "inner").drop("its")
    if strict:
        joined = joined.withColumn("gene_index", F.coalesce("gene_index", F.raise_error(F.concat(F.lit("unknown gene "), F.col("gene"))).cast("long")))
    return joined


def first_seen(alignments: DataFrame) -> DataFrame:
    """cell, first_rec: where each counted cell appears first."""
    return molecules(alignments).groupBy("cell").agg(F.min("first_rec").alias("first_rec"))


def dense_index(rows: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """rows with a dense index from 0 in the order of columns. keep: the columns that stay (None: all); others are neither written nor kept.

    No task sees all rows: a range sort is written to the checkpoint folder once, which fixes what is in each
    partition, and numbers rows within its partitions, whose sizes are then summed. Rows may have columns of any name.
    """
    plain = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
    by = [f"_{rows.columns.index(c)}" for c in order]
    names = rows.columns if keep is None else keep
    kept = [f"_{rows.columns.index(c)}" for c in names]
    dealt = written_once(plain.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept))
    dealt = dealt.withColumn("part", F.spark_partition_id())
    dealt = dealt.withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select(F.col("part").alias("its"), F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start"))
    joined = dealt.join(F.broadcast(starts), dealt["part"] == starts["its"])
    return joined.select(*kept, (F.col("start") + F.col("k")).alias("index")).toDF(*names, name)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch: the partition, how many rows of it come before, how many there are, and the batch, compressed."""
    from pyspark import TaskContext

    part, first = TaskContext.get().partitionId(), 0
    for b in batches:
        if b.num_rows:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(b)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "n": [b.num_rows], "data": pa.array([out.getvalue().to_pybytes()], pa.binary())})
            first += b.num_rows


def placed(ordered: DataFrame, name: str) -> DataFrame:
    """ordered (sorted over its partitions in order) with a dense index from 0 in this order.

    Rows are written to the checkpoint folder once, as compressed batches: a row of its own for each takes several times a number's bytes there.
    """
    names = [f"_{i}" for i in range(len(ordered.columns))]
    blocks = written_once(ordered.toDF(*names).mapInArrow(_packed, "part int, first long, n long, data binary"))
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("size"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select(F.col("part").alias("its"), F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start"))
    joined = blocks.join(F.broadcast(starts), blocks["part"] == starts["its"]).select((F.col("start") + F.col("first")).alias("first"), "data")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for rows in pa.ipc.open_stream(data.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.arange(first, first + rows.num_rows))], names=[*names, "index"])

    fields = [StructField(n, f.dataType) for n, f in zip(names, ordered.schema.fields, strict=True)]
    return joined.mapInArrow(unpacked, StructType([*fields, StructField("index", LongType())])).toDF(*ordered.columns, name)


def cell_index(alignments: DataFrame) -> DataFrame:
    """cell, cell_index: in the order of first appearance."""
    return dense_index(first_seen(alignments), ["first_rec", "cell"], "cell_index").select("cell", "cell_index")


def merge_counts(*chunks: DataFrame) -> DataFrame:
    """Chunks hold disjoint cells: their rows, one after the other."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out
