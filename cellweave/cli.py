"""Command line: python -m cellweave.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.sequence import read_structure
from .operators import barcodes, counts, genes, grouping, metrics, qc, tagging
from .session import session
from .sources import raw, readers, sinks
from .sources.formats import register

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None]) -> Callable:
    def add(f: Callable) -> Callable:
        COMMANDS[name] = (arguments, f)
        return f

    return add


def _header(paths: list[str]) -> list[str]:
    """Header lines of the first SAM file; of BAM files the references only."""
    first = raw.expanded(paths)[0]
    if first.endswith(".sam"):
        out = []
        for _, line in raw.lines(first):
            if not line.startswith("@"):
                break
            out.append(line)
        return out
    import struct

    with raw.opened(first) as stream:
        stream.read(4)
        text = stream.read(struct.unpack("<i", stream.read(4))[0]).decode().rstrip("\0\n")
    return text.split("\n") if text else []


def _outputs(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", required=True)


def _written(rows, output: str, header: list[str]) -> None:  # noqa: ANN001
    """The one file that x.bam names, or a folder of SAM or BAM parts."""
    if output.endswith(".bam"):
        sinks.single_bam(rows, output, header)
    else:
        sinks.alignments(rows, output, header, "sam" if output.endswith(".sam") else "bam")


def _attach(spark: SparkSession, a: argparse.Namespace, layout: dict) -> None:
    r1 = readers.fastq(spark, a.r1)
    i1 = readers.fastq(spark, a.i1) if a.i1 else None
    wl = readers.whitelist(spark, a.whitelist) if a.whitelist else None
    done = tagging.attach_barcodes(readers.alignments(spark, a.u2), r1, layout, i1, wl)
    _written(done, a.output, _header([a.u2]))


def _attach_10x_arguments(p: argparse.ArgumentParser) -> None:
    for name, needed in (("--r1", True), ("--u2", True), ("--i1", False)):
        p.add_argument(name, required=needed)
    p.add_argument("-w", "--whitelist")
    _outputs(p)


def _attach_arguments(p: argparse.ArgumentParser) -> None:
    _attach_10x_arguments(p)
    for kind in ("sample", "cell", "molecule"):
        p.add_argument(f"--{kind}-barcode-start-position", type=int)
        p.add_argument(f"--{kind}-barcode-length", type=int)


@command("Attach10xBarcodes", _attach_10x_arguments)
def attach_10x(spark: SparkSession, a: argparse.Namespace) -> None:
    _attach(spark, a, {k: b for k, b in tagging.TEN_X_V2.items() if k != "sample" or a.i1})


@command("AttachBarcodes", _attach_arguments)
def attach(spark: SparkSession, a: argparse.Namespace) -> None:
    where = {}
    for kind in ("sample", "cell", "molecule"):
        start, length = getattr(a, f"{kind}_barcode_start_position"), getattr(a, f"{kind}_barcode_length")
        if start is not None or length is not None:
            where[kind] = (start, length)
    _attach(spark, a, tagging.layout(**where, has_index=bool(a.i1)))


def _split_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-b", "--bamfile", nargs="+", required=True)
    p.add_argument("-p", "--output-prefix", required=True)
    p.add_argument("-s", "--subfile-size", type=float, default=1000)
    p.add_argument("-t", "--tags", nargs="+", required=True)
    p.add_argument("--num-processes", type=int)
    p.add_argument("--drop-missing", action="store_true")


@command("SplitBam", _split_arguments)
def split(spark: SparkSession, a: argparse.Namespace) -> None:
    n = grouping.parts_of(raw.total_size(a.bamfile) / 1e6, a.subfile_size)
    bins = grouping.split_bins(readers.alignments(spark, a.bamfile, dense=False), a.tags, n, required=not a.drop_missing)
    sinks.binned_alignments(bins, a.output_prefix, n, _header(a.bamfile))


def _metric_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-i", "--input-bam", required=True)
    p.add_argument("-o", "--output-filestem", required=True)
    p.add_argument("-a", "--gtf-annotation-file")


@command("CalculateCellMetrics", _metric_arguments)
def calculate_cell(spark: SparkSession, a: argparse.Namespace) -> None:
    mito = genes.mitochondrial_genes(readers.gtf(spark, a.gtf_annotation_file)) if a.gtf_annotation_file else None
    sinks.metrics_file(metrics.cell_metrics(readers.alignments(spark, a.input_bam, dense=False), mito), a.output_filestem)


@command("CalculateGeneMetrics", _metric_arguments)
def calculate_gene(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.metrics_file(metrics.gene_metrics(readers.alignments(spark, a.input_bam, dense=False)), a.output_filestem)


def _merge_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("metric_files", nargs="+")
    p.add_argument("-o", "--output-filestem", required=True)


@command("MergeCellMetrics", _merge_arguments)
def merge_cell(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.metrics_file(metrics.merge_cell_metrics(*[readers.metrics_csv(spark, f, "CB") for f in a.metric_files]), a.output_filestem)


@command("MergeGeneMetrics", _merge_arguments)
def merge_gene(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.metrics_file(metrics.merge_gene_metrics(*[readers.metrics_csv(spark, f, "GE") for f in a.metric_files]), a.output_filestem)


def _count_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-b", "--bam-file", required=True)
    p.add_argument("-o", "--output-prefix", required=True)
    p.add_argument("-a", "--gtf-annotation-file", required=True)
    p.add_argument("-c", "--cell-barcode-tag", default="CB")
    p.add_argument("-m", "--molecule-barcode-tag", default="UB")
    p.add_argument("-g", "--gene-id-tag", default="GE")
    p.add_argument("-n", "--sn-rna-seq-mode", action="store_true")


@command("CreateCountMatrix", _count_arguments)
def create_counts(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.alignments(spark, a.bam_file, dense=False)
    rows = _with_tags(rows, CB=a.cell_barcode_tag, UB=a.molecule_barcode_tag, GE=a.gene_id_tag)
    index = genes.gene_index(readers.gtf(spark, a.gtf_annotation_file))
    found = counts.count_matrix(rows, index, strict=True)
    sinks.count_archive(found.select("cell", "gene", "n"), a.output_prefix, counts.cell_index(rows), index)


def _merge_counts_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-i", "--input-prefixes", nargs="+", required=True)
    p.add_argument("-o", "--output-stem", required=True)


@command("MergeCountMatrices", _merge_counts_arguments)
def merge_counts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows of the archives one after the other; their columns must be the same genes."""
    columns = [readers.archive_names(spark, p, "gene") for p in a.input_prefixes]
    if any(not c.exceptAll(columns[0]).isEmpty() or c.count() != columns[0].count() for c in columns[1:]):
        raise ValueError("the archives have other genes")
    rows, chunks, start = None, [], 0
    for p in a.input_prefixes:
        names = readers.archive_names(spark, p, "cell")
        moved = names.withColumn("cell_index", F.col("cell_index") + start)
        rows = moved if rows is None else rows.unionByName(moved)
        chunks.append(readers.archive_entries(spark, p).withColumn("cell_index", F.col("cell_index") + start))
        start += names.count()
    sinks.write_archive(counts.merge_counts(*chunks), rows, columns[0], a.output_stem)


def _sort_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-i", "--input-bam", required=True)
    p.add_argument("-o", "--output-bam")
    p.add_argument("-t", "--tags", nargs="+", action="append", required=True)


def _flat(tags: list[list[str]]) -> list[str]:
    return [t for group in tags for t in group]


@command("TagSortBam", _sort_arguments)
def tag_sort(spark: SparkSession, a: argparse.Namespace) -> None:
    _written(grouping.tag_sort(readers.alignments(spark, a.input_bam, dense=False), _flat(a.tags)), a.output_bam, _header([a.input_bam]))


@command("VerifyBamSort", _sort_arguments)
def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    grouping.verify_sort(readers.alignments(spark, a.input_bam, dense=False), _flat(a.tags))
    print(f"{a.input_bam} is sorted by {_flat(a.tags)}")


def _qc_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-f", "--file-names", nargs="+", required=True)
    p.add_argument("-o", "--output-name", required=True)
    p.add_argument("-t", "--metrics-type", required=True, choices=["Picard", "PicardTable", "Core", "HISAT2", "RSEM"])


@command("GroupQCs", _qc_arguments)
def group_qcs(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.metrics_type == "Core":
        tables = [spark.read.csv(f, header=True).withColumnRenamed("_c0", "sample") for f in a.file_names]
        sinks.qc_csv(qc.outer_merged(*tables), a.output_name)
    elif a.metrics_type == "PicardTable":
        for f in a.file_names:
            sinks.qc_csv(qc.picard_table(qc.whole_files(spark, [f])), f"{a.output_name}_{f.rsplit('/', 1)[-1].split('.')[1]}")
    else:
        rows = {"Picard": qc.picard_metrics, "HISAT2": qc.hisat2_metrics, "RSEM": qc.rsem_metrics}[a.metrics_type]
        sinks.qc_csv(qc.with_classes(rows(qc.whole_files(spark, a.file_names))), a.output_name)


def _fastq_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--R1", nargs="+", required=True)
    p.add_argument("--R2", nargs="+")
    p.add_argument("--I1", nargs="*", default=[])
    p.add_argument("--white-list")
    p.add_argument("--sample-id", default="")
    p.add_argument("--bam-size", type=float, default=1.0)
    p.add_argument("--barcode-length", type=int)
    p.add_argument("--umi-length", type=int)
    p.add_argument("--read-structure")
    p.add_argument("--output-format", choices=["BAM", "FASTQ"], default="BAM")
    _outputs(p)


def _tagged_reads(spark: SparkSession, a: argparse.Namespace):  # noqa: ANN202
    """Reads of R2 with barcodes of R1, file by file, corrected; pairs of files are numbered. And the bad records of all files.

    A record that is bad in one file is left out of the others, too.
    """
    if a.I1 and len(a.I1) != len(a.R1) or a.R2 and len(a.R2) != len(a.R1):
        raise ValueError("as many R2 (and I1) files as R1 files are needed")
    if a.read_structure:
        read_structure(a.read_structure)
    elif not a.barcode_length or not a.umi_length or min(a.barcode_length, a.umi_length) < 1:
        raise ValueError("barcode and UMI length, or a read structure")
    out = failed = None
    for k, (r1, r2) in enumerate(zip(a.R1, a.R2, strict=True)):
        files = {"R1": r1, "R2": r2} | ({"I1": a.I1[k]} if a.I1 else {})
        reads, bad = tagging.in_step({name: readers.fastq(spark, f, keep_bad=True) for name, f in files.items()})
        reads = {name: r.withColumn("file", F.lit(str(k))) for name, r in reads.items()}
        if a.read_structure:
            tags = tagging.extract_structure(reads["R1"], a.read_structure)
        else:
            b, u = a.barcode_length, a.umi_length
            tags = tagging.extract(reads["R1"], [tagging.Embedded(0, b, "CR", "CY"), tagging.Embedded(b, b + u, "UR", "UY")])
        if a.I1:
            tags = tags.join(reads["I1"].select("file", "rec", F.col("sequence").alias("SR"), F.col("quality").alias("SY")), ["file", "rec"])
        made = tagging.unmapped_records(reads["R2"], tags)
        out, failed = (made, bad) if out is None else (out.unionByName(made), failed.unionByName(bad))
    return barcodes.correct(out, readers.whitelist(spark, a.white_list)), failed


def _as_alignments(reads):  # noqa: ANN001, ANN202
    from .functions.sequence import phred
    from .schema import ALIGNMENTS

    none = {"rname": None, "cigar": None, "rnext": None, "NH": None}
    number = {"ref_id": -1, "pos": -1, "mapq": 255, "pnext": -1, "tlen": 0}
    rows = reads.withColumns({k: F.lit(v) for k, v in (none | number).items()} | {"qual": phred(F.col("quality")), "tags": F.create_map(F.lit("RG"), F.col("RG")), "tag_types": F.create_map(F.lit("RG"), F.lit("Z"))})
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ALIGNMENTS.fields], "shard")


def _shards(spark: SparkSession, a: argparse.Namespace) -> None:
    n = grouping.parts_of(raw.total_size([*a.R1, *(a.R2 or []), *a.I1]) / 2**20, a.bam_size * 1024)
    tagged, bad = _tagged_reads(spark, a)
    reads = grouping.shard(tagged, n)
    if a.output_format == "FASTQ":
        sinks.fastq_shards(reads, a.output)
    else:
        sinks.binned_alignments(_as_alignments(reads), a.output, n, sinks.shard_header(a.sample_id), by="shard")
    barcodes.correction_tally(reads, "file").show(truncate=False)
    tagging.bad_counts(bad).show(truncate=False)


for _name in ("fastqprocess", "fastq_slideseq"):
    command(_name, _fastq_arguments)(_shards)


@command("samplefastq", _fastq_arguments)
def sample_fastq(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.downsampled_fastq(_tagged_reads(spark, a)[0], a.output)


@command("fastq_metrics", _fastq_arguments)
def fastq_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    tags = tagging.extract_structure(readers.fastq(spark, a.R1, dense=False), a.read_structure)
    for tag, mark in (("UR", "XM"), ("CR", "XC")):
        sinks.barcode_tables(barcodes.counts_descending(tags, tag).select("n", "barcode"), f"{a.output}/{a.sample_id}.numReads_perCell_{mark}.txt")
        sinks.barcode_tables(barcodes.position_weights(tags, tag).orderBy("position"), f"{a.output}/{a.sample_id}.barcode_distribution_{mark}.txt")


#: Options of the tags and the columns that hold them.
TAG_COLUMNS = {"barcode": "CB", "umi": "UB", "gene": "GE"}


class _InOrder(argparse.Action):
    """Keeps the value, and in order the names of the tag options as they come."""

    def __call__(self, parser, space, value, option=None):  # noqa: ANN001
        setattr(space, self.dest, value)
        name = self.dest.removesuffix("_tag")
        space.order = [*[n for n in getattr(space, "order", None) or [] if n != name], name]


def _with_tags(rows, **tags: str):  # noqa: ANN001, ANN202
    """Alignments with the tags named in the columns of the usual ones."""
    return rows.withColumns({c: F.col(t) if t in rows.columns else F.element_at("tags", t) for c, t in tags.items()})


def _tag_sort_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--bam-input", required=True)
    p.add_argument("--gtf-file")
    p.add_argument("--temp-folder")
    p.add_argument("--sorted-output")
    p.add_argument("--metric-output")
    p.add_argument("--metric-type", choices=["cell", "gene"])
    p.add_argument("--compute-metric", action="store_true")
    p.add_argument("--output-sorted-info", action="store_true")
    p.add_argument("--alignments-per-thread", type=int, default=1_000_000)
    p.add_argument("--nthreads", type=int, default=1)
    for name in TAG_COLUMNS:
        p.add_argument(f"--{name}-tag", required=True, action=_InOrder)
    p.add_argument("--mitochondrial-gene-names-filename")


@command("TagSort", _tag_sort_arguments)
def tag_sort_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tags sort in the order in which they are given."""
    if not a.compute_metric and not a.output_sorted_info:
        raise ValueError("nothing to do: neither metrics nor sorted output is asked for")
    if a.alignments_per_thread < 1000 or not 1 <= a.nthreads <= 30:
        raise ValueError("1000 alignments a thread at least, and 1 to 30 threads")
    if a.compute_metric and (not a.metric_type or not a.metric_output or a.metric_type == "cell" and not a.gtf_file):
        raise ValueError("metrics need a type and an output, those of cells an annotation")
    rows = _with_tags(readers.alignments(spark, a.bam_input, dense=False), **{c: getattr(a, f"{n}_tag") for n, c in TAG_COLUMNS.items()})
    if a.output_sorted_info:
        features = metrics.read_features(rows)
        sinks.sorted_text(features.orderBy(*[F.coalesce(F.col(TAG_COLUMNS[n]), F.lit("")) for n in a.order]), a.sorted_output)
    if a.compute_metric and a.metric_type == "cell":
        names = readers.gene_list(spark, a.mitochondrial_gene_names_filename) if a.mitochondrial_gene_names_filename else None
        mito = genes.mitochondrial_genes(readers.gtf(spark, a.gtf_file), names)
        sinks.metrics_file(metrics.cell_metrics(rows, mito, drop_null=True), a.metric_output)
    elif a.compute_metric:
        sinks.metrics_file(metrics.gene_metrics(rows, drop_null=True), a.metric_output)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cellweave")
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in COMMANDS.items():
        arguments(commands.add_parser(name))
    a = parser.parse_args(args)
    COMMANDS[a.command][1](register(session(a.master)), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
