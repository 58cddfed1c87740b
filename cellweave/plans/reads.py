"""The driver's tables as alignments: lineitem and part, by integer arithmetic only."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import removed, shuffles_removed
from ..sources.raw import total_size
from ..sources.splits import SPLIT

BASES = "ACTG"


def dna(x: Column, n: int) -> Column:
    """The last n base-4 digits of a number as letters."""
    parts, left = [], n
    while left:
        k = min(left, 4)
        left -= k
        word = F.shiftright(x.cast("long"), 2 * left).bitwiseAND(F.lit(4**k - 1)).cast("int")
        parts.append(F.get(F.split(F.lit(",".join(map("".join, product(BASES, repeat=k)))), ","), word))
    return F.concat(*parts)


#: (key * 7 + i * 11) % 41 for i from 0 on is this cycle from place key * 7 * 15 % 41 on, 15 being the inverse of 11.
CYCLE = [i * 11 % 41 for i in range(41 + 16)]


def _place(key: Column) -> Column:
    return (F.pmod(key * (7 * 15), F.lit(41)) + 1).cast("int")


def qualities(key: Column, n: int) -> Column:
    """n numbers from 0 to 40."""
    return F.slice(F.lit(CYCLE), _place(key), F.lit(n))


def characters(key: Column, n: int) -> Column:
    """The same as quality characters."""
    return F.substring(F.lit("".join(chr(33 + q) for q in CYCLE)), _place(key), F.lit(n))


#: Alignments of a file that a query writes, about.
FILE_ROWS = 500_000
#: Bytes of a split of such files, at least; how many splits they are cut into at most, if that isn't more than a reader's own splits.
SPLIT_BYTES, SPLITS = 1 << 18, 48


def pieces(spark: SparkSession, sf_dir: str, least: int) -> int:
    """How many files the alignments are written to: more as they grow, so that no task has more than so many."""
    return max(least, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // FILE_ROWS))


def split_bytes(paths: str | list[str]) -> int:
    """Bytes of a split: small, so that small tables have several, but not so many that tasks cost more than their work."""
    return min(SPLIT, max(SPLIT_BYTES, total_size([paths] if isinstance(paths, str) else paths) // SPLITS))


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alignments are made of, a narrow row each: for what is shuffled or written on the way."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"), "l_returnflag", "l_linestatus")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return rows.withColumn("NH", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).cast("int"))


#: Bytes of such rows in a file that a task reads: a million of them, about, so that what a task sorts or shuffles is bounded.
NARROW_BYTES = 8 << 20


@contextlib.contextmanager
def kept(rows: DataFrame, path: str) -> Iterator[DataFrame]:
    """Narrow rows from a folder of files, written once, for what is written in the meantime; shuffle files behind them go at once, those behind what is written as it is, the folder at the end."""
    spark = rows.sparkSession
    with shuffles_removed(spark, spark_sql_files_maxPartitionBytes=str(NARROW_BYTES)):
        try:
            rows.write.parquet(path, compression="zstd")
            yield spark.read.schema(rows.schema).parquet(path)
        finally:
            removed(spark, path)


def made() -> dict[str, Column]:
    """The columns of alignments, of narrow rows."""
    order, part, supplier, number = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    off = (part % 10 == 0).cast("long")
    flag = F.when(number == 4, 4).otherwise(0) + F.when(F.col("l_linestatus") == "F", 16).otherwise(0) + F.when(supplier % 3 == 0, 1024).otherwise(0)
    location = F.when(F.col("l_returnflag") == "A", "CODING").when(F.col("l_returnflag") == "R", "INTRONIC").when(F.col("l_linestatus") == "F", "UTR").otherwise("INTERGENIC")
    cigar = F.when(part % 7 == 0, "6M100N6M").when(part % 5 == 1, "2S10M").otherwise("12M")
    gene = F.when(number == 5, F.concat_ws(",", "p_brand", "p_type")).when(number != 6, F.col("p_brand"))
    return {
        "file": F.concat(F.lit("f"), (order % 4).cast("string")),
        "rec": (order * 8 + number) * (1 << 32) + part * (1 << 12) + supplier,
        "qname": F.concat(F.lit("Q"), order.cast("string")),
        "flag": flag.cast("int"),
        "rname": F.col("l_returnflag"),
        "pos": F.col("l_quantity").cast("int"),
        "cigar": cigar,
        "CB": F.when(number != 7, dna(supplier, 8)),
        "CR": dna(supplier + off, 8),
        "CY": characters(supplier, 8),
        "UB": dna(part % 1024, 5),
        "UR": dna((part + off) % 1024, 5),
        "UY": characters(part, 5),
        "GE": gene,
        "XF": F.when(number != 3, location),
        "NH": F.col("NH"),
        "qual": qualities(order, 12),
    }


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return based(spark, sf_dir).select(*[c.alias(n) for n, c in made().items()])


def _dna_sql(x: str, n: int) -> str:
    return f"array_to_string(list_transform(range({n - 1}, -1, -1), lambda i: substr('{BASES}', CAST((({x}) >> CAST(2 * i AS INTEGER)) & 3 AS INTEGER) + 1, 1)), '')"


def _quality_sql(key: str, n: int) -> str:
    return f"list_transform(range({n}), lambda i: CAST((({key}) * 7 + i * 11) % 41 AS INTEGER))"


#: The same for DuckDB, as common table expressions that queries start with. Qualities are numbers (cq, uq, gq).
READS_SQL = f"""
WITH base AS (
  SELECT *, CAST(l_partkey % 10 = 0 AS BIGINT) AS off FROM lineitem JOIN part ON l_partkey = p_partkey
), reads AS (
  SELECT 'f' || (l_orderkey % 4) AS file, (l_orderkey * 8 + l_linenumber) * 4294967296 + l_partkey * 4096 + l_suppkey AS rec,
         'Q' || l_orderkey AS qname, l_linenumber = 4 AS unmapped, l_linestatus = 'F' AS rev, l_suppkey % 3 = 0 AS dup,
         l_returnflag AS rname, CAST(l_quantity AS INTEGER) AS pos, l_partkey % 7 = 0 AS spliced,
         CASE WHEN l_linenumber <> 7 THEN {_dna_sql("l_suppkey", 8)} END AS CB, {_dna_sql("l_suppkey + off", 8)} AS CR,
         {_dna_sql("l_partkey % 1024", 5)} AS UB, {_dna_sql("(l_partkey + off) % 1024", 5)} AS UR,
         {_quality_sql("l_suppkey", 8)} AS cq, {_quality_sql("l_partkey", 5)} AS uq,
         CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 5 = 1 THEN list_slice({_quality_sql("l_orderkey", 12)}, 3, 12) ELSE {_quality_sql("l_orderkey", 12)} END AS gq,
         CASE WHEN l_linenumber = 5 THEN p_brand || ',' || p_type WHEN l_linenumber <> 6 THEN p_brand END AS GE,
         CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_returnflag = 'A' THEN 'CODING' WHEN l_returnflag = 'R' THEN 'INTRONIC' WHEN l_linestatus = 'F' THEN 'UTR' ELSE 'INTERGENIC' END END AS XF,
         CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS NH, l_suppkey, l_partkey, l_orderkey
  FROM base
)"""


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """barcode, line_no: a barcode for each supplier key."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(dna(F.col("s_suppkey"), 8).alias("barcode"), F.col("s_suppkey").alias("line_no"))


WHITELIST_SQL = f"wl AS (SELECT {_dna_sql('s_suppkey', 8)} AS barcode, s_suppkey AS line_no FROM supplier)"


def gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as annotation: genes (every third an exon), places by key, brands as names, some mitochondrial."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.when(F.col("p_size") % 10 == 0, F.lit("mt-")).otherwise(F.lit("")), F.col("p_brand"))
    return p.select(
        F.col("p_partkey").alias("rec"),
        F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")).alias("seqname"),
        F.lit("made").alias("source"),
        F.when(F.col("p_partkey") % 3 == 0, "exon").otherwise("gene").alias("feature"),
        (F.col("p_partkey") * 10).cast("int").alias("start"),
        (F.col("p_partkey") * 10 + F.col("p_size") * 100).cast("int").alias("end"),
        F.lit(".").alias("score"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit(".").alias("frame"),
        F.create_map(F.lit("gene_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")), F.lit("gene_name"), name).alias("attributes"),
    )


GTF_SQL = """gtf AS (
  SELECT p_partkey AS rec, 'chr' || (p_size % 5) AS seqname, CASE WHEN p_partkey % 3 = 0 THEN 'exon' ELSE 'gene' END AS feature,
         CAST(p_partkey * 10 AS INTEGER) AS "start", CAST(p_partkey * 10 + p_size * 100 AS INTEGER) AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
         'G' || p_partkey AS gene_id, CASE WHEN p_size % 10 = 0 THEN 'mt-' ELSE '' END || p_brand AS gene FROM part)"""
