"""Queries that write files from the driver's tables, read them again through the library and count; and their SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import barcodes, counts, genes, grouping, metrics, qc, tagging
from ..operators.counts import dense_index
from ..shared import removed, shared_folder, written_once
from ..sources import raw, readers, sinks
from ..sources.raw import located
from .reads import GTF_SQL, READS_SQL, WHITELIST_SQL, alignments, based, gtf, kept, made, pieces, split_bytes, whitelist

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Fixed value: between the two parts of a rebuilt read's barcode.
SPACER = "CTTCAGCGTTCCCGAGAG"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@contextlib.contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        removed(spark, path)


def parts(spark: SparkSession, path: str, start: str = "part-") -> list[str]:
    """The files of a folder, in the order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    return sorted(n.toString() for n in names if n.getName().startswith(start))


def _text(rows: DataFrame, path: str, order: str, n: int = 2) -> None:
    """Column value as text files, in the order of a column over all of them."""
    rows.repartitionByRange(n, order).sortWithinPartitions(order).select("value").write.text(path)


def _reads(rows: DataFrame, path: str, n: int = 2) -> None:
    """Barcodes of alignments as n FASTQ files."""
    text = F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname")), F.concat("CR", "UR"), F.lit("+"), F.concat("CY", "UY"))
    _text(rows.select("rec", text.alias("value")), path, "rec", n)


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(alignments(spark, sf_dir))


def _completed(rows: DataFrame) -> DataFrame:
    """Alignments with every field that files of them have."""
    some = {"mapq": F.lit(60), "rnext": F.lit(None), "pnext": F.lit(-1), "tlen": F.lit(0), "seq": F.concat("CR", F.substring("UR", 1, 4))}
    return rows.withColumns(some | {"tags": F.create_map().cast("map<string,string>")})


HEADER = ["@HD\tVN:1.6", *[f"@SQ\tSN:{r}\tLN:1000" for r in "ANR"]]



def _sorted_bam(spark: SparkSession, sf_dir: str, path: str, tags: list[str]) -> str:
    """One BAM file in a folder, sorted by tags: narrow rows are joined and written first, then sorted, so that shuffles of the two are never there together."""
    target = f"{path}/sorted.bam"
    located(path)[0].create_dir(located(path)[1])
    with kept(based(spark, sf_dir), f"{path}/narrow") as rows:
        sinks.single_bam(_completed(grouping.tag_sort(rows, tags, made())), target, HEADER)
    return target


# alignments


@query(f"{READS_SQL} SELECT CB, count(*) AS n, CAST(0 AS BIGINT) AS n_late, count(*) FILTER (rname = 'A') AS n_here FROM reads GROUP BY CB")
def one_sorted_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments sorted by tags in one BAM file; rows out of order in it, and how many a look at one reference finds."""
    with folder(spark) as path:
        target = _sorted_bam(spark, sf_dir, path, ["CB", "UB"])
        rows = readers.alignments(spark, target, columns=["file", "rec", "qname", "CB", "UB"], split=split_bytes(target))
        late = grouping.out_of_order(rows, ["CB", "UB"]).select("CB", F.lit(1).cast("long").alias("late"), F.lit(0).cast("long").alias("here"), F.lit(0).cast("long").alias("n"))
        here = readers.alignments(spark, target, columns=["CB"], reference="A").select("CB", F.lit(0).cast("long").alias("late"), F.lit(1).cast("long").alias("here"), F.lit(0).cast("long").alias("n"))
        every = rows.select("CB", F.lit(0).cast("long").alias("late"), F.lit(0).cast("long").alias("here"), F.lit(1).cast("long").alias("n"))
        return written_once(every.unionByName(here).unionByName(late).groupBy("CB").agg(F.sum("n").alias("n"), F.sum("late").alias("n_late"), F.sum("here").alias("n_here")))


@query(f"{READS_SQL}, k AS (SELECT coalesce(CB, CR) AS b FROM reads), r AS (SELECT b, (row_number() OVER (ORDER BY b) - 1) % 7 AS bin FROM (SELECT DISTINCT b FROM k)) SELECT bin, count(*) AS n, count(DISTINCT b) AS n_barcodes FROM k JOIN r USING (b) GROUP BY bin")
def binned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a bin, several where there are many alignments, counted by file name."""
    each = -(-pieces(spark, sf_dir, 7) // 7)
    with folder(spark) as path:
        sinks.binned_alignments(grouping.split_bins(_full(spark, sf_dir), ["CB", "CR"], 7), path, 7, HEADER, files=each)
        rows = readers.alignments(spark, path, "rb", dense=False, columns=["file", "CB", "CR"])
        number = F.floor(F.regexp_extract("file", r"part-(\d+)", 1).cast("long") / each)
        return written_once(rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("CB", "CR")).alias("n_barcodes")))


@query(f"{READS_SQL} SELECT coalesce(CB, CR) AS barcode, count(*) AS n, CAST(1 AS BIGINT) AS n_files FROM reads GROUP BY ALL")
def sharded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by barcode as BAM files: in how many of them a barcode is."""
    n = pieces(spark, sf_dir, 4)
    with folder(spark) as path:
        sinks.binned_alignments(grouping.shard(_full(spark, sf_dir), n), path, n, [*sinks.shard_header("s"), *HEADER[1:]], by="shard")
        rows = readers.alignments(spark, path, "rb", dense=False, columns=["file", "CB", "CR"])
        return written_once(rows.groupBy(F.coalesce("CB", "CR").alias("barcode")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files")))


@query(f"{READS_SQL} SELECT CAST(4 AS BIGINT) AS flag, 'A' AS grp, CR, UR, count(*) AS n FROM reads GROUP BY CR, UR")
def unmapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a place, of reads and their tags by ordinal."""
    with folder(spark) as path:
        _reads(alignments(spark, sf_dir), path, pieces(spark, sf_dir, 2))
        reads = readers.fastq(spark, parts(spark, path))
        made = tagging.unmapped_records(reads, tagging.extract(reads, [tagging.Embedded(0, 8, "CR", "CY"), tagging.Embedded(8, 13, "UR", "UY")]))
        return written_once(made.groupBy(F.col("flag").cast("long").alias("flag"), F.col("RG").alias("grp"), "CR", "UR").agg(F.count(F.lit(1)).alias("n")))


@query(f"{READS_SQL} SELECT coalesce(GE, 'None') AS gene, coalesce(XF, '-') AS place, count(*) AS n FROM reads GROUP BY ALL")
def tag_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy(seq.tag_or(F.col("GE"), "None").alias("gene"), seq.tag_or(F.col("XF"), "-").alias("place")).agg(F.count(F.lit(1)).alias("n"))


# FASTQ


@query(f"{READS_SQL} SELECT CAST(rec // 4294967296 // 8 % 2 AS BIGINT) AS lane, count(*) AS n, CAST(sum(length(qname) + 32) AS BIGINT) AS bytes FROM reads GROUP BY 1")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and bytes of files: orders with odd and even keys."""
    rows = alignments(spark, sf_dir).withColumn("lane", F.pmod(F.shiftright("rec", 35), F.lit(2)))
    found = None
    with folder(spark) as path:
        for k in (0, 1):
            _reads(rows.filter(F.col("lane") == k), f"{path}/{k}", pieces(spark, sf_dir, 2))
            files = parts(spark, f"{path}/{k}")
            counted = readers.fastq(spark, files, dense=False, columns=["file"]).groupBy(F.lit(k).cast("long").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
            counted = written_once(counted.withColumn("bytes", F.lit(raw.total_size(files)).cast("long")))
            found = counted if found is None else found.unionByName(counted)
    return found


@query(f"{READS_SQL} SELECT CR || '{SPACER}' || UR || 'T' AS sequence, count(*) AS n FROM reads WHERE CB IS NOT NULL GROUP BY 1")
def downsampled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt reads 1 of those with a corrected barcode."""
    with folder(spark) as path:
        sinks.downsampled_fastq(_full(spark, sf_dir).withColumn("quality", F.concat("CY", F.substring("UY", 1, 4))), path)
        return written_once(readers.fastq(spark, parts(spark, f"{path}/R1"), dense=False, columns=["sequence"]).groupBy("sequence").agg(F.count(F.lit(1)).alias("n")))


WITH_WL = f"{READS_SQL}, {WHITELIST_SQL}"
_CORRECTED = f"{WITH_WL}, c AS (SELECT CR, arg_max(barcode, line_no) AS b FROM (SELECT DISTINCT CR FROM reads) LEFT JOIN wl ON hamming(CR, barcode) <= 1 GROUP BY CR)"


@query(f"{_CORRECTED} SELECT CR, b AS CB, UR, count(*) AS n FROM reads JOIN c USING (CR) GROUP BY ALL")
def extract_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of reads, corrected against a whitelist that comes in files of lines."""
    rows = alignments(spark, sf_dir).select("file", "rec", F.concat("CR", "UR").alias("sequence"), F.concat("CY", "UY").alias("quality"))
    with folder(spark) as path:
        _text(whitelist(spark, sf_dir).select("line_no", F.col("barcode").alias("value")), path, "line_no")
        known = readers.whitelist(spark, parts(spark, path))
        found = tagging.extract_corrected(rows, tagging.Embedded(0, 8, "CR", "CY"), known, [tagging.Embedded(8, 13, "UR", "UY")])
        return written_once(found.groupBy("CR", "CB", "UR").agg(F.count(F.lit(1)).alias("n")))


@query(f"{_CORRECTED} SELECT CR, b AS CB, count(*) AS n FROM reads JOIN c USING (CR) GROUP BY ALL")
def correct_by_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction as for large whitelists."""
    return barcodes.correct(alignments(spark, sf_dir), whitelist(spark, sf_dir), most=0).groupBy("CR", "CB").agg(F.count(F.lit(1)).alias("n"))


@query(f"{READS_SQL} SELECT CR AS barcode, count(*) AS n FROM reads GROUP BY CR")
def barcode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of barcodes as tab-separated text, the most frequent first."""
    with folder(spark) as path:
        sinks.barcode_tables(barcodes.counts_descending(alignments(spark, sf_dir), "CR").select("n", "barcode"), path)
        return written_once(spark.read.schema("n long, barcode string").csv(path, sep="\t").select("barcode", "n"))


@query(f"{READS_SQL} SELECT CR AS barcode, count(*) AS n FROM reads GROUP BY CR")
def barcode_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of barcodes made from encoded ones."""
    coded = alignments(spark, sf_dir).select(seq.encode_two_bit(F.col("CR")).alias("code"))
    return barcodes.Barcodes.from_encoded(coded, 8).rows


# metrics and counts


@query(f"{READS_SQL} SELECT CB, count(*) AS n, CAST(0 AS BIGINT) AS n_late FROM reads GROUP BY CB")
def sorted_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of alignments as sorted text; lines that come before the one before them."""
    keys = ["CB", "UB", "GE"]
    with folder(spark) as path:
        rows = metrics.read_features(alignments(spark, sf_dir))
        rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
        sinks.sorted_text(rows.orderBy(*[F.coalesce(F.col(k), F.lit("")) for k in keys]), path)
        lines = readers.lines(spark, parts(spark, path)).withColumn("file", F.lit("all"))
        fields = F.split("line", "\t")
        marked = grouping.with_previous(lines.select("file", "rec", F.slice(fields, 1, 3).alias("keys")), F.col("keys"))
        own = F.nullif(F.get("keys", F.lit(0)), F.lit(""))
        return written_once(marked.groupBy(own.alias("CB")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("keys") < F.col("before.value")).alias("n_late")))


@query(f"{READS_SQL}, by_gene AS (SELECT GE, count(*) AS n, count(*) FILTER (coalesce(UR = UB, false)) AS perfect FROM reads WHERE coalesce(instr(GE, ',') = 0, true) GROUP BY GE) SELECT GE, n AS n_reads, perfect AS perfect_molecule_barcodes FROM by_gene")
def metrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of genes by reference, as CSV files, read again and merged."""
    rows = alignments(spark, sf_dir)
    with folder(spark) as path:
        located(path)[0].create_dir(located(path)[1])
        for r in "ANR":
            sinks.metrics_file(metrics.gene_metrics(rows.filter(F.col("rname") == r)), f"{path}/{r}")
        merged = metrics.merge_gene_metrics(*[readers.metrics_csv(spark, f"{path}/{r}.csv.gz", "GE") for r in "ANR"])
        return written_once(merged.select("GE", "n_reads", "perfect_molecule_barcodes"))


_COUNTED = f"""{READS_SQL}, firsts AS (SELECT qname, arg_min(coalesce(CB, ''), rec) AS cell, arg_min(coalesce(UB, ''), rec) AS molecule, count(DISTINCT g) AS n_genes, min(g) AS gene FROM
  (SELECT qname, rec, CB, UB, CASE WHEN GE IS NOT NULL AND XF IS NOT NULL AND XF <> 'INTERGENIC' AND instr(GE, ',') = 0 THEN GE END AS g FROM reads) GROUP BY qname)
SELECT cell, gene, count(DISTINCT molecule) AS n FROM firsts WHERE n_genes = 1 AND cell <> '' AND molecule <> '' GROUP BY cell, gene"""


@query(f"{READS_SQL}, m AS (SELECT CB, UB, GE, count(*) AS n FROM reads GROUP BY ALL), f AS (SELECT CB, UB, GE, rname, pos, rev, count(*) AS n FROM reads WHERE NOT unmapped GROUP BY ALL), x AS (SELECT CB, count(*) AS n_molecules, count(*) FILTER (n = 1) AS molecules_single, CAST(sum(n) AS BIGINT) AS n_reads, count(DISTINCT coalesce(GE, '')) AS n_genes FROM m GROUP BY CB), y AS (SELECT CB, count(*) AS n_fragments, count(*) FILTER (n = 1) AS fragments_single FROM f GROUP BY CB) SELECT x.*, n_fragments, fragments_single FROM x JOIN y ON x.CB IS NOT DISTINCT FROM y.CB")
def sorted_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of cells from a sorted BAM file read in splits: reads aren't shuffled."""
    with folder(spark) as path:
        target = _sorted_bam(spark, sf_dir, path, ["CB", "UB", "GE"])
        found = metrics.cell_metrics(readers.alignments(spark, target, dense=False, split=split_bytes(target)), order=("CB", "UB", "GE"))
        names = {"molecules_with_single_read_evidence": "molecules_single", "fragments_with_single_read_evidence": "fragments_single"}
        return written_once(found.select("CB", *[F.col(c).alias(names.get(c, c)) for c in ("n_reads", "n_genes", "n_molecules", "n_fragments", *names)]))


@query(_COUNTED)
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two disjoint sets of cells as archives, stacked in a third, read again."""
    found = written_once(counts.count_matrix(alignments(spark, sf_dir)))
    index = dense_index(found.select("gene").distinct(), ["gene"], "gene_index")
    with folder(spark) as path:
        located(path)[0].create_dir(located(path)[1])
        rows, chunks, start = None, [], 0
        for k in (0, 1):
            mine = found.filter(F.pmod(F.ascii(F.substring("cell", 8, 1)), F.lit(4)).cast("int").isin([2 * k, 2 * k + 1]))
            sinks.count_archive(mine, f"{path}/{k}", None, index)
            names = readers.archive_names(spark, f"{path}/{k}", "cell")
            moved = names.withColumn("cell_index", F.col("cell_index") + start)
            rows = moved if rows is None else rows.unionByName(moved)
            chunks.append(readers.archive_entries(spark, f"{path}/{k}").withColumn("cell_index", F.col("cell_index") + start))
            start += names.count()
        sinks.write_archive(counts.merge_counts(*chunks), rows, index, f"{path}/both")
        return written_once(readers.count_archive(spark, f"{path}/both"))


@query(_COUNTED)
def matrix_market_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as coordinates in text, and files of names."""
    found = written_once(counts.count_matrix(alignments(spark, sf_dir)))
    with folder(spark) as path:
        placed = found
        for what in ("cell", "gene"):
            names = dense_index(found.select(what).distinct(), [what], "k")
            _text(names.select("k", F.col(what).alias("value")), f"{path}/{what}", "k")
            placed = placed.join(names.withColumnRenamed("k", f"{what}_k"), what)
        body = placed.select((F.col("cell_k") + 1).alias("k"), F.concat_ws(" ", F.col("cell_k") + 1, F.col("gene_k") + 1, "n").alias("value"))
        head = spark.range(3).select((F.col("id") - 3).alias("k"), F.element_at(F.array(*map(F.lit, ("%%MatrixMarket matrix coordinate integer general", "% made of reads", "0 0 0"))), (F.col("id") + 1).cast("int")).alias("value"))
        _text(head.unionByName(body), f"{path}/x", "k", 3)
        return written_once(readers.matrix_market(spark, *[parts(spark, f"{path}/{n}") for n in ("x", "cell", "gene")]))


# annotation


@query(f"WITH {GTF_SQL} SELECT seqname, feature, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" - \"start\" AS BIGINT) AS size, strand, gene_id, gene FROM gtf")
def gtf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation as lines of text under comments, read again."""
    rows = gtf(spark, sf_dir)
    with folder(spark) as path:
        head = spark.range(2).select((F.col("id") - 2).alias("rec"), F.lit("#!comment").alias("value"))
        _text(head.unionByName(rows.select("rec", genes.serialised(rows).alias("value"))), path, "rec")
        again = readers.gtf(spark, parts(spark, path))
        shown = again.select("seqname", "feature", F.col("start").cast("long").alias("start"), genes.size(F.col("start"), F.col("end")).cast("long").alias("size"), "strand", *[F.element_at("attributes", k).alias(n) for k, n in (("gene_id", "gene_id"), ("gene_name", "gene"))])
        return written_once(shown)


@query(f"WITH {GTF_SQL} SELECT DISTINCT gene_id AS gene FROM gtf WHERE feature = 'gene' AND (lower(gene) LIKE 'mt-%' OR gene IN (SELECT DISTINCT p_brand FROM part WHERE p_size % 25 = 1))")
def gene_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mitochondrial genes by name and by a list in a file with comments and blank lines."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 25 = 1").select(F.col("p_brand").alias("value")).distinct()
    with folder(spark) as path:
        noted = spark.range(2).select(F.element_at(F.array(F.lit("# a comment"), F.lit("")), (F.col("id") + 1).cast("int")).alias("value"))
        _text(noted.unionByName(names), path, "value")
        return written_once(genes.mitochondrial_genes(gtf(spark, sf_dir), readers.gene_list(spark, parts(spark, path))))


@query(f"""WITH {GTF_SQL}, g AS (SELECT seqname, gene, arg_max("start", rec) AS s, arg_max("end", rec) AS e FROM gtf WHERE feature = 'gene' GROUP BY ALL)
SELECT seqname AS chromosome, row_number() OVER (PARTITION BY seqname ORDER BY s, e, gene) - 1 AS place, gene FROM g""")
def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genes.gene_places_sorted(gtf(spark, sf_dir)).select("chromosome", F.posexplode("genes").alias("place", "it"))
    return found.select("chromosome", F.col("place").cast("long").alias("place"), F.col("it.gene").alias("gene"))


# quality logs


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, segment, n: customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.groupBy(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("sample"), F.regexp_replace("c_mktsegment", " ", "_").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def _logs(texts: DataFrame, path: str) -> None:
    """A file for each sample (one a nation): name, text."""
    system, inner = located(path)
    system.create_dir(inner)
    for r in texts.toLocalIterator():
        with system.open_output_stream(f"{inner}/{r['name']}") as out:
            out.write(r["text"].encode())


_NATIONS = "n AS (SELECT 's' || c_nationkey AS sample, replace(c_mktsegment, ' ', '_') AS segment, count(*) AS n FROM customer GROUP BY ALL)"


def _picard(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "segment", F.col("n").cast("string"), F.lit("")))), "\n")
    text = F.concat(F.lit("## htsjdk\n# made\n\n## METRICS CLASS\tpicard.analysis.AlignmentSummaryMetrics\nCATEGORY\tTOTAL_READS\tSAMPLE\n"), body, F.lit("\n\n## HISTOGRAM\tx\n1\t2\n"))
    return _by_nation(spark, sf_dir).groupBy("sample").agg(text.alias("text")).select(F.concat("sample", F.lit("_qc.alignment_summary_metrics.txt")).alias("name"), "text")


@query(f"WITH {_NATIONS} SELECT sample, 'TOTAL_READS.' || segment AS metric, CAST(n AS VARCHAR) AS value FROM n UNION ALL SELECT DISTINCT 'Class', 'TOTAL_READS.' || segment, 'AlignmentSummaryMetrics' FROM n")
def picard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of alignment summaries as one CSV table, read again."""
    with folder(spark) as path:
        _logs(_picard(spark, sf_dir), path)
        table = qc.with_classes(qc.picard_metrics(qc.whole_files(spark, [path])))
        sinks.qc_csv(table, f"{path}/all")
        again = spark.read.csv(f"{path}/all.csv", header=True).withColumnRenamed("_c0", "sample")
        names = [c for c in again.columns if c != "sample"]
        return written_once(again.unpivot("sample", [F.col(f"`{c}`") for c in names], "metric", "value").filter("value is not null"))


@query(f"WITH {_NATIONS} SELECT sample AS \"Sample\", segment AS \"CATEGORY\", CAST(n AS VARCHAR) AS \"TOTAL_READS\" FROM n")
def picard_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs row by row."""
    with folder(spark) as path:
        _logs(_picard(spark, sf_dir), path)
        table = qc.picard_table(qc.whole_files(spark, [path]))  # its columns Sample and SAMPLE differ in case only
        return written_once(table.toDF("Sample", "CATEGORY", "TOTAL_READS", "other").drop("other"))


@query(f"""WITH {_NATIONS}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS total, min(n) AS least FROM n GROUP BY sample)
SELECT sample, 'HISAT2G' AS class, 'Total pairs' AS metric, CAST(total AS VARCHAR) AS value FROM t UNION ALL SELECT sample, 'HISAT2G', 'Aligned 0 time', CAST(least AS VARCHAR) FROM t
UNION ALL SELECT sample, 'RSEM', unnest(['unalignable reads', 'alignable reads', 'filtered reads', 'total reads', 'unique aligned', 'multiple mapped', 'uncertain reads', 'total alignments', 'strand']),
  unnest([CAST(least AS VARCHAR), CAST(total AS VARCHAR), '0', CAST(total + least AS VARCHAR), CAST(total AS VARCHAR), '1', '2', CAST(total AS VARCHAR), '3']) FROM t""")
def aligner_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of an aligner and a quantifier, as rows."""
    sums = _by_nation(spark, sf_dir).groupBy("sample").agg(F.sum("n").cast("string").alias("total"), F.min("n").cast("string").alias("least"), (F.sum("n") + F.min("n")).cast("string").alias("both"))
    log = F.concat(F.lit("HISAT2 summary stats:\n\tTotal pairs: "), "total", F.lit("\n\t\tAligned 0 time: "), "least", F.lit(" (7.52%)\n"))
    cnt = F.concat("least", F.lit(" "), "total", F.lit(" 0 "), "both", F.lit("\n"), "total", F.lit(" 1 2\n"), "total", F.lit(" 3\n0\t1\n"))
    with folder(spark) as path:
        _logs(sums.select(F.concat("sample", F.lit("_qc.log")).alias("name"), log.alias("text")), f"{path}/hisat")
        _logs(sums.select(F.concat("sample", F.lit("_rsem.cnt")).alias("name"), cnt.alias("text")), f"{path}/rsem")
        rows = qc.hisat2_metrics(qc.whole_files(spark, [f"{path}/hisat"])).unionByName(qc.rsem_metrics(qc.whole_files(spark, [f"{path}/rsem"])))
        return written_once(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
