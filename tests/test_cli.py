import gzip
from pathlib import Path

import pytest

from cellweave.cli import main
from cellweave.sources import readers
from test_sources import FASTQ, GTF, HEADER


@pytest.fixture
def files(tmp_path):
    """Five reads with barcodes, five alignments with genes."""
    barcodes = ["AAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAC", "CCCCCCCCCCCCCCCC", "GGGGGGGGGGGGGGGG", "NCCCCCCCCCCCCCCC"]
    r1 = "".join(f"@r{i}\n{b}{'ACGTACGTA'}{'ACGTA'[i]}\n+\n{'I' * 26}\n" for i, b in enumerate(barcodes))
    (tmp_path / "r1.fastq").write_text(r1)
    (tmp_path / "r2.fastq").write_text(FASTQ)
    (tmp_path / "wl.txt").write_text("AAAAAAAAAAAAAAAA\nCCCCCCCCCCCCCCCC\n")
    tags = "UR:Z:{u}\tUB:Z:{u}\tUY:Z:IIII\tCY:Z:IIII\tGE:Z:{g}\tXF:Z:CODING\tNH:i:1"
    lines = [f"r{i}\t0\t19\t{100 + i}\t60\t4M\t*\t0\t0\tACGT\tIIII\t" + tags.format(u="ACGT"[i % 4] * 4, g=["mt-A", "B"][i % 2]) for i in range(5)]
    (tmp_path / "u2.sam").write_text("\n".join([*HEADER, *lines]) + "\n")
    (tmp_path / "x.gtf").write_text(GTF)
    return tmp_path


def test_attach_metrics_counts_sort_split(spark, files):
    f = lambda n: str(files / n)
    assert main(["Attach10xBarcodes", "--r1", f("r1.fastq"), "--u2", f("u2.sam"), "-o", f("tagged.bam"), "-w", f("wl.txt")]) == 0
    tagged = readers.alignments(spark, f("tagged.bam"), mode="rb")
    assert {r.CR: r.CB for r in tagged.collect()} == {"A" * 16: "A" * 16, "A" * 15 + "C": "A" * 16, "C" * 16: "C" * 16, "G" * 16: None, "N" + "C" * 15: "C" * 16}
    main(["AttachBarcodes", "--r1", f("r1.fastq"), "--u2", f("u2.sam"), "-o", f("other.sam"), "--cell-barcode-start-position", "0", "--cell-barcode-length", "8", "--molecule-barcode-start-position", "16", "--molecule-barcode-length", "4"])
    assert {r.UR for r in readers.alignments(spark, f("other.sam")).collect()} == {"ACGT"}
    main(["TagSortBam", "-i", _one(files / "tagged.bam"), "-o", f("sorted.bam"), "-t", "CB", "UB", "-t", "GE"])
    main(["VerifyBamSort", "-i", _one(files / "sorted.bam"), "-t", "CB", "UB", "GE"])
    main(["CalculateCellMetrics", "-i", _one(files / "sorted.bam"), "-o", f("cells"), "-a", f("x.gtf")])
    lines = gzip.decompress((files / "cells.csv.gz").read_bytes()).decode().splitlines()
    assert len(lines) == 4 and lines[0].startswith(",n_reads,noise_reads")
    main(["CalculateGeneMetrics", "-i", _one(files / "sorted.bam"), "-o", f("genes.csv")])
    main(["MergeGeneMetrics", f("genes.csv"), f("genes.csv"), "-o", f("merged")])
    merged = readers.metrics_csv(spark, f("merged.csv.gz"), "GE")
    assert {r.GE: r.n_reads for r in merged.collect()} == {"mt-A": 6, "B": 4}
    main(["MergeCellMetrics", f("cells.csv.gz"), "-o", f("all")])
    main(["CreateCountMatrix", "-b", _one(files / "sorted.bam"), "-o", f("counts"), "-a", f("x.gtf")])
    main(["MergeCountMatrices", "-i", f("counts"), f("counts"), "-o", f("twice")])
    assert readers.count_archive(spark, f("counts")).count() == 3
    main(["SplitBam", "-b", _one(files / "sorted.bam"), "-p", f("split"), "-t", "CB", "CR"])
    assert readers.alignments(spark, f("split"), mode="rb").count() == 5
    main(["TagSort", "--bam-input", _one(files / "sorted.bam"), "--gtf-file", f("x.gtf"), "--compute-metric", "--metric-type", "cell", "--metric-output", f("native"), "--output-sorted-info", "--sorted-output", f("sorted.tsv"), "--barcode-tag", "CB", "--umi-tag", "UB", "--gene-tag", "GE"])
    assert (files / "native.csv.gz").exists()
    common = ["TagSort", "--bam-input", _one(files / "sorted.bam"), "--output-sorted-info", "--sorted-output", f("other.tsv")]
    main([*common, "--gene-tag=GE", "--umi-tag", "UB", "--barcode-tag=CR"])
    got = [line.split("\t") for p in sorted((files / "other.tsv").glob("part-*.csv")) for line in p.read_text().splitlines()]
    assert len(got) == 5 and [(r[2], r[1], r[0]) for r in got] == sorted((r[2], r[1], r[0]) for r in got) and {len(r[0]) for r in got} == {16}
    with pytest.raises(ValueError):
        main(["TagSort", "--bam-input", "x.bam", "--barcode-tag", "CB", "--umi-tag", "UB", "--gene-tag", "GE"])


def _one(folder: Path) -> str:
    """The file; of a folder of parts the part if there is one only."""
    if folder.is_file():
        return str(folder)
    parts = sorted(folder.glob("part-*"))
    return str(parts[0] if len(parts) == 1 else folder)


def test_fastq_commands(spark, files):
    f = lambda n: str(files / n)
    common = ["--R1", f("r1.fastq"), "--R2", f("r2.fastq"), "--white-list", f("wl.txt"), "--sample-id", "s"]
    main(["fastqprocess", *common, "--barcode-length", "16", "--umi-length", "10", "-o", f("shards")])
    rows = readers.alignments(spark, f("shards"), mode="rb").collect()
    assert len(rows) == 5 and {r.flag for r in rows} == {4} and sum(r.CB is None for r in rows) == 1
    main(["fastq_slideseq", *common, "--read-structure", "16C10M", "--output-format", "FASTQ", "-o", f("fq")])
    assert spark.read.text(f("fq/R1")).count() == 20
    main(["samplefastq", *common, "--read-structure", "16C10M", "-o", f("sample")])
    assert spark.read.text(f("sample/R2")).count() == 16
    main(["fastq_metrics", "--R1", f("r1.fastq"), "--read-structure", "16C10M", "--sample-id", "s", "-o", f("fm")])
    assert (files / "fm/s.numReads_perCell_XC.txt").exists()
    with pytest.raises(ValueError):
        main(["fastqprocess", *common, "-o", f("none")])


def test_group_qcs(spark, tmp_path):
    (tmp_path / "s1_qc.log").write_text("title\nTotal pairs: 5\n")
    (tmp_path / "s1_rsem.cnt").write_text("1 2 0 3\n4 5 6\n7 3\n")
    for kind, name in (("HISAT2", "s1_qc.log"), ("RSEM", "s1_rsem.cnt")):
        main(["GroupQCs", "-f", str(tmp_path / name), "-o", str(tmp_path / kind), "-t", kind])
    assert (tmp_path / "HISAT2.csv").read_text() == ",Total pairs\nClass,HISAT2G\ns1,5\n"
    main(["GroupQCs", "-f", str(tmp_path / "HISAT2.csv"), str(tmp_path / "RSEM.csv"), "-o", str(tmp_path / "core"), "-t", "Core"])
    assert len((tmp_path / "core.csv").read_text().splitlines()) == 3
