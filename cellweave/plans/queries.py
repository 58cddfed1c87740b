"""Named queries over the driver's tables, and the SQL they are checked against.

Every query reads its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import barcodes, counts, genes, grouping, metrics, qc, tagging
from ..shared import removed, shared_folder, written_once
from ..sources import readers, sinks
from ..streaming import molecules
from . import files
from .oracles import ORACLES
from .reads import alignments, based, gtf, kept, made, pieces, split_bytes, whitelist

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Ordinals of 16 orders: small, so that rows are handed on between stretches.
STRETCH = 1 << 39


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-10, 6).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _long(c: Column) -> Column:
    return c.cast("long")


# sources, positions


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads with every field that files of alignments have."""
    return _completed(alignments(spark, sf_dir))


def _completed(rows: DataFrame) -> DataFrame:
    some = {"mapq": F.lit(60), "rnext": F.lit(None), "pnext": F.lit(-1), "tlen": F.lit(0), "seq": F.concat("CR", F.substring("UR", 1, 4))}
    tags = {"tags": F.create_map(F.lit("AS"), F.col("pos").cast("string"), F.lit("XG"), F.col("rname")), "tag_types": F.create_map(F.lit("AS"), F.lit("i"), F.lit("XG"), F.lit("A"))}
    return rows.withColumns(some | tags)


def _scanned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Reads written as files in blocks, read again and counted; the files go. What reads are made of is joined before, its shuffles go before files are written."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    try:
        with kept(based(spark, sf_dir), f"{folder}-narrow") as narrow:
            rows = _completed(narrow.select(*[c.alias(n) for n, c in made().items()]))
            sinks.alignments(rows, folder, ["@HD\tVN:1.6", *[f"@SQ\tSN:{r}\tLN:1000" for r in "ANR"]], kind, blocks=kind == "sam")
        used = ["rname", "flag", "cigar", "qual", "NH", "CB", "GE", "tags", "tag_types"]
        rows = readers.alignments(spark, folder, {"sam": "r", "bam": "rb"}[kind], dense=False, columns=used)
        score, place = F.element_at("tags", "AS").cast("long"), F.element_at("tag_types", "AS")
        flags = {n: F.count_if(seq.has_flag(F.col("flag"), b)) for b, n in ((4, "n_unmapped"), (16, "n_reverse"), (1024, "n_duplicate"))}
        sums = {"score": F.sum(score), "quality": F.sum(F.aggregate("qual", F.lit(0).cast("long"), lambda s, q: s + q)), "hits": F.sum("NH"), "n_cells": F.count_distinct("CB"), "n_genes": F.count_distinct("GE"), "n_typed": F.count_if(place.isin("i", "c", "C", "s", "S", "I"))}
        counted = rows.groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.count_if(seq.spliced(F.col("cigar"))).alias("n_spliced"), *[c.alias(k) for k, c in (flags | sums).items()])
        return written_once(counted)
    finally:
        removed(spark, folder)


@query
def scan_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "bam")


@query
def scan_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "sam")


@query
def scan_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of FASTQ files, written, read again and counted by barcode; the files go."""
    folder = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    rows = alignments(spark, sf_dir).withColumns({"seq": F.concat("CR", "UR"), "quality": F.concat("CY", "UY")})
    try:
        sinks.fastq_shards(grouping.shard(rows, pieces(spark, sf_dir, 3)), folder)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/R1")
        parts = [f.getPath().toString() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop) if f.isDirectory()]
        local = [p.removeprefix("file:") if not p.startswith("file://") else p for p in parts]
        reads = readers.fastq(spark, local)
        found = tagging.extract(reads, [tagging.Embedded(0, 8, "CR", "CY"), tagging.Embedded(8, 13, "UR", "UY")])
        return written_once(found.groupBy("CR", "UR").agg(F.count(F.lit(1)).alias("n"), F.min("CY").alias("least_quality")))
    finally:
        removed(spark, folder)


def _local(spark: SparkSession, folder: str, pattern: str = "part-") -> list[str]:
    """The files of a folder in the order of their names, as paths that the readers open."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().toString() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop) if f.getPath().getName().startswith(pattern))
    return [n.removeprefix("file:") if not n.startswith("file://") else n for n in names]


def _lanes(rows: DataFrame, path: str, n: int, sequence: Column, quality: Column, name: Column | None = None) -> None:
    """n FASTQ files, plain text, of the rows in the order of their ordinals over all files."""
    name = F.concat(F.lit("@"), F.col("qname")) if name is None else name
    text = F.concat_ws("\n", name, sequence, F.lit("+"), quality).alias("value")
    rows.repartitionByRange(n, "rec").sortWithinPartitions("rec").select(text).write.text(path)


@query
def attach_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of reads in three files onto alignments in two, by ordinal over all files; files are read in splits of 256 KB, larger ones where there are many."""
    n = pieces(spark, sf_dir, 3)
    folder = f"{shared_folder(spark)}/lanes-{uuid.uuid4().hex}"
    rows = _full(spark, sf_dir)
    try:
        _lanes(rows, f"{folder}/r1", n, F.concat("CR", "UR"), F.concat("CY", "UY"))
        named = rows.select("rec", *[c for c in rows.columns if c not in ("rec", "CR", "CY", "UR", "UY", "tags", "tag_types")], F.create_map(F.lit("XR"), F.concat("CR", "UR")).alias("tags"))
        sinks.alignments(named.repartitionByRange(max(2, n - 1), "rec").sortWithinPartitions("rec"), f"{folder}/u2", ["@HD\tVN:1.6", *[f"@SQ\tSN:{r}\tLN:1000" for r in "ANR"]])
        files, bams = _local(spark, f"{folder}/r1"), _local(spark, f"{folder}/u2")
        reads = readers.fastq(spark, files, columns=["file", "rec", "sequence", "quality"], split=split_bytes(files))
        bam = readers.alignments(spark, bams, "rb", columns=["rec", "qname", "tags"], split=split_bytes(bams))
        done = tagging.attach_barcodes(bam, reads, tagging.layout(cell=(0, 8), molecule=(8, 5)))
        own = F.element_at("tags", "XR") == F.concat("CR", "UR")
        return written_once(done.groupBy("CR", "UR").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("n_own")))
    finally:
        removed(spark, folder)


@query
def broken_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files in step, each with broken records of its own: what is left of each order's reads, and the bad ones by file and fault."""
    folder, n = f"{shared_folder(spark)}/broken-{uuid.uuid4().hex}", pieces(spark, sf_dir, 2)
    rows = alignments(spark, sf_dir)
    at, barcode, quality = F.pmod(F.shiftright("rec", 32), F.lit(8)), F.concat("CR", "UR"), F.concat("CY", "UY")
    name = F.concat(F.when(at == 2, F.lit("")).otherwise(F.lit("@")), F.col("qname"))
    try:
        _lanes(rows, f"{folder}/R1", n, barcode, quality, name)
        _lanes(rows, f"{folder}/R2", n, barcode, F.when(at == 3, F.concat(quality, F.lit("I"))).otherwise(quality))
        _lanes(rows, f"{folder}/I1", n, F.col("UR"), F.when(at == 2, F.lit("")).otherwise(F.col("UY")))
        files = {k: _local(spark, f"{folder}/{k}") for k in ("R1", "R2", "I1")}
        kept, bad = tagging.in_step({k: readers.fastq(spark, files[k], keep_bad=True, columns=["file", "rec", "name", "sequence", "bad"], split=split_bytes(files[k])) for k in files})
        fine = tagging.zipped(*[kept[k].select("rec", F.col("sequence").alias(k)) for k in kept])
        good = fine.groupBy(F.substring("R1", 1, 8).alias("barcode"), F.lit("kept").alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("R1") == F.col("R2")) & F.col("R1").endswith(F.col("I1"))).alias("n_alike"))
        lost = bad.groupBy(F.col("read").alias("barcode"), "fault").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_alike"))
        return written_once(good.unionByName(lost))
    finally:
        removed(spark, folder)


@query
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order, by ordinal."""
    rows = alignments(spark, sf_dir)
    wanted = rows.groupBy("qname").agg(F.min("rec").alias("rec"))
    return readers.select_records(rows, wanted).groupBy("qname", "rec").agg(F.count(F.lit(1)).alias("n"))


@query
def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers side by side by ordinal, as far as the shorter goes."""
    left = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rec"), "o_orderstatus")
    right = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("rec"), "c_mktsegment")
    return tagging.zipped(left, right)


@query
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.features(gtf(spark, sf_dir), "exon").select("rec", "seqname", _long(F.col("start")).alias("start"), _long(F.col("end")).alias("end"))


# sequences


@query
def extract_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).select("file", "rec", F.concat("CR", "UR").alias("sequence"), F.concat("CY", "UY").alias("quality"))
    found = tagging.extract(rows, [tagging.Embedded(0, 8, "CR", "CY"), tagging.Embedded(8, 13, "UR", "UY")])
    return found.groupBy("CR", "UR").agg(F.count(F.lit(1)).alias("n"))


@query
def extract_read_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).select("file", "rec", F.concat("CR", "UR").alias("sequence"), F.concat("CY", "UY").alias("quality"))
    return tagging.extract_structure(rows, "3C2X3C4M1X").groupBy("CR", "UR").agg(F.count(F.lit(1)).alias("n"))


@query
def avg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).select("CR", seq.mean_quality(F.col("CY")).alias("q"))
    return _rounded(rows.groupBy("CR").agg(F.min("q").alias("q_min"), F.max("q").alias("q_max")))


@query
def frac_above_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).select("rname", seq.share_above(seq.phred(F.col("CY"))).alias("cell"), seq.share_above(seq.aligned_part(F.col("qual"), F.col("cigar"))).alias("genomic"))
    return _rounded(rows.groupBy("rname").agg(F.avg("cell").alias("cell"), F.avg("genomic").alias("genomic")))


@query
def features17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of sorted output, one row an alignment."""
    return _rounded(metrics.read_features(alignments(spark, sf_dir)))


@query
def first_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy(seq.first_tag(F.col("CB"), F.col("CR")).alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


@query
def encode_two_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitelist(spark, sf_dir)
    code = seq.encode_two_bit(F.col("barcode"))
    return rows.select("barcode", code.alias("code"), seq.decode_two_bit(code, F.length("barcode")).alias("decoded"), _long(seq.gc_count_encoded(code, 2)).alias("gc"))


@query
def encode_three_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitelist(spark, sf_dir)
    code = seq.encode_three_bit(F.col("barcode"))
    return rows.select("barcode", code.alias("code"), seq.decode_three_bit(code).alias("decoded"), _long(seq.gc_count_encoded(code, 3)).alias("gc"))


@query
def gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy(_long(seq.gc_count(F.concat("CR", "UR"))).alias("gc")).agg(F.count(F.lit(1)).alias("n"))


@query
def hamming_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).filter("CB is not null")
    codes = [seq.encode_two_bit(F.col(c)) for c in ("CB", "CR")]
    return rows.groupBy(_long(seq.hamming(F.col("CB"), F.col("CR"))).alias("text_distance"), _long(seq.hamming_encoded(*codes, bits=2)).alias("code_distance")).agg(F.count(F.lit(1)).alias("n"))


@query
def read_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir)
    bits = [seq.has_flag(F.col("flag"), b).alias(n) for b, n in ((4, "unmapped"), (16, "reverse"), (1024, "duplicate"))]
    return rows.groupBy(*bits, seq.spliced(F.col("cigar")).alias("spliced")).agg(F.count(F.lit(1)).alias("n"))


# whitelists and barcode sets


@query
def whitelist_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = barcodes.variants(whitelist(spark, sf_dir))
    return found.groupBy("corrected").agg(F.count(F.lit(1)).alias("n_variants"))


@query
def whitelist_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = barcodes.correct(alignments(spark, sf_dir), whitelist(spark, sf_dir))
    return done.groupBy("CR", "CB").agg(F.count(F.lit(1)).alias("n"))


@query
def correct_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.correct_alignments(alignments(spark, sf_dir), whitelist(spark, sf_dir)).groupBy("CB").agg(F.count(F.lit(1)).alias("n"))


@query
def correction_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(barcodes.correction_tally(barcodes.correct(alignments(spark, sf_dir), whitelist(spark, sf_dir)), "file"))


@query
def distinct_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.distinct_barcodes(alignments(spark, sf_dir), ["CB", "CR"])


@query
def barcode_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.multiset(alignments(spark, sf_dir), "UR")


@query
def reads_per_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.counts_descending(alignments(spark, sf_dir), "CR")


@query
def base_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(barcodes.base_frequency(alignments(spark, sf_dir), "CR"))


@query
def effective_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(barcodes.effective_diversity(alignments(spark, sf_dir), "CR"))


@query
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(barcodes.position_weights(alignments(spark, sf_dir), "UR"))


@query
def hamming_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(barcodes.hamming_summary(whitelist(spark, sf_dir)))


@query
def partition_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.partition_overlap(alignments(spark, sf_dir))


# metrics


def _mito(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 25 = 0").select(F.col("p_brand").alias("gene")).distinct()


@query
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.cell_metrics(alignments(spark, sf_dir), _mito(spark, sf_dir)))


@query
def gene_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.gene_metrics(alignments(spark, sf_dir)))


@query
def online_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).groupBy("CB", "UB").agg(F.avg("pos").alias("mean"), F.var_samp("pos").alias("variance"))
    return _rounded(rows)


@query
def merge_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of cells by chunk of disjoint cells, put together."""
    rows = alignments(spark, sf_dir)
    part = F.pmod(F.length("CB") + F.ascii(F.substring("CB", 8, 1)), F.lit(2))
    chunks = [metrics.cell_metrics(rows.filter(F.col("CB").isNotNull() & (part == k)), _mito(spark, sf_dir)) for k in (0, 1)]
    return _rounded(metrics.merge_cell_metrics(*chunks))


@query
def merge_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of genes by chunk, merged."""
    rows = alignments(spark, sf_dir)
    chunks = [metrics.gene_metrics(rows.filter(F.col("rname") == r)) for r in ("A", "N", "R")]
    return _rounded(metrics.merge_gene_metrics(*chunks))


# counts


@query
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_matrix(alignments(spark, sf_dir))


@query
def count_matrix_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the annotation's genes, with the gene's index."""
    return counts.count_matrix(alignments(spark, sf_dir), genes.gene_index(gtf(spark, sf_dir)))


@query
def count_matrix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir)
    return counts.merge_counts(*[counts.count_matrix(rows.filter(F.col("file") == f"f{k}")) for k in range(4)]).groupBy("cell", "gene").agg(F.sum("n").alias("n"))


@query
def cell_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cell_index(alignments(spark, sf_dir))


@query
def streamed_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream: distinct (user, kind, ten-minute window) counted by user and kind."""
    return molecules.streamed_counts(spark, sf_dir)


@query
def streamed_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from increments of counts, by a keyed state that is dropped as time passes."""
    return molecules.streamed_increments(spark, sf_dir)


# order and parts


@query
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs within files, ordered in stretches of 16 orders."""
    return grouping.run_sizes(alignments(spark, sf_dir).select("file", "rec", "GE"), "GE", width=STRETCH)


@query
def query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.queries(alignments(spark, sf_dir))


@query
def verify_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of order by file, looked at in stretches of 16 orders."""
    found = grouping.out_of_order(alignments(spark, sf_dir).select("file", "rec", "qname", "CB", "UB"), ["CB", "UB"], width=STRETCH)
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def tag_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.tag_sort(alignments(spark, sf_dir).select("rec", "qname", "CB", "UB", "GE"), grouping.tag_order("BUG"))


@query
def tag_order_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every alignment in each order of the tags."""
    columns = {n: made()[n] for n in ("rec", "qname", "CB", "UB", "GE")}
    narrow = based(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_type")
    with kept(narrow, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}") as rows:
        placed = [grouping.tag_places(rows, grouping.tag_order(o), keep=["rec"], made=columns).select(F.lit(o).alias("tags"), "rec", "place") for o in grouping.TAG_ORDERS]
    return reduce(DataFrame.unionByName, placed)


@query
def subset_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return grouping.subset(alignments(spark, sf_dir).select("rec", "rname", "qname"), 20, "A", 5)


@query
def split_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = grouping.split_bins(alignments(spark, sf_dir), ["CB", "CR"], 7)
    return done.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("CB", "CR")).alias("n_barcodes")).select(_long(F.col("bin")).alias("bin"), "n", "n_barcodes")


@query
def shard_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each barcode's rows, in how many shards they are (one), and whether that is one of the 16."""
    done = grouping.shard(alignments(spark, sf_dir), 16)
    each = done.groupBy(F.coalesce("CB", "CR").alias("barcode"), "shard").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("barcode").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"), F.bool_and(F.col("shard").between(0, 15)).alias("known"))


# annotation


@query
def gene_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.gene_index(gtf(spark, sf_dir))


@query
def mito_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.mitochondrial_genes(gtf(spark, sf_dir))


@query
def gene_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(genes.gene_places(gtf(spark, sf_dir)))


@query
def gene_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genes.gene_exons(gtf(spark, sf_dir))
    shown = F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select("chromosome", "gene", shown.alias("exons"))


@query
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("chr"), (F.col("c_nationkey") % 5).cast("string")).alias("chromosome"), (F.col("c_custkey") * 13).cast("int").alias("at"))
    inside = genes.containing(points, genes.gene_places(gtf(spark, sf_dir)), width=1 << 10)
    return inside.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("gene"))


@query
def gtf_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute text back to columns; the last of repeated keys stays."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; tag "first"; gene_name "'), F.col("p_brand"), F.lit('"; tag "'), F.col("p_type"), F.lit('";\n'))
    found = p.select("p_partkey", genes.attributes(text).alias("a"))
    return found.select("p_partkey", *[F.element_at("a", k).alias(k) for k in ("gene_id", "gene_name", "tag")])


# quality logs


@query
def qc_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as samples, order priorities as metrics: long rows to a table."""
    return qc.pivoted(_qc_rows(spark, sf_dir))


def _qc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    sums = orders.groupBy(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("sample"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return sums.select("sample", F.lit("Orders").alias("class"), F.concat(F.lit("N"), "p").alias("metric"), F.col("n").cast("string").alias("value"))


@query
def qc_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by nation, outer."""
    tables = []
    for name, key, label in (("customer", "c_nationkey", "customers"), ("supplier", "s_nationkey", "suppliers")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").groupBy(F.concat(F.lit("s"), F.col(key).cast("string")).alias("sample")).agg(F.count(F.lit(1)).alias(label))
        tables.append(rows)
    return qc.outer_merged(*tables)


@query
def native_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of cells without the null one."""
    return _rounded(metrics.cell_metrics(alignments(spark, sf_dir), _mito(spark, sf_dir), drop_null=True))


def queries() -> dict[str, Query]:
    return _QUERIES | files.queries()


def oracle_sql() -> dict[str, str]:
    return ORACLES | files.ORACLES
