import bz2
import gzip
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import counts, genes, grouping, qc, tagging
from cellweave.sources import raw, readers, sinks

FASTQ = "".join(f"@r{i} x\n{'ACGT' * 6}AC\n+\n{'I' * 26}\n" for i in range(5))
HEADER = ["@HD\tVN:1.6", "@SQ\tSN:19\tLN:1000000", "@SQ\tSN:21\tLN:2000000"]
SAM = "\n".join(
    [
        *HEADER,
        "a\t0\t19\t101\t60\t2S6M100N4M\t=\t201\t100\tACGTACGTACGT\tIIIIIIIIII!!\tCB:Z:AAAA\tUB:Z:CC\tNH:i:1\tXX:Z:left",
        "b\t4\t*\t0\t0\t*\t*\t0\t0\tACGTN\t*\tCR:Z:AAAA",
        "c\t16\t21\t5\t3\t5M\t*\t0\t0\tACGTA\tABCDE\tNH:i:2\tGE:Z:g1,g2",
    ]
) + "\n"
GTF = '#!a\n#b\n19\tx\tgene\t60951\t71626\t.\t-\t.\tgene_id "G1"; gene_name "mt-A"; tag "one"; tag "two";\n19\tx\texon\t60951\t61000\t.\t-\t.\tgene_id "G1"; gene_name "mt-A";\n19\tx\tgene\t80000\t90000\t.\t+\t.\tgene_id "G2"; gene_name "B";\n'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ + "@cut\nAC\n")
    (tmp_path / "b.txt").write_bytes(gzip.compress(FASTQ.encode()))
    (tmp_path / "c.fastq").write_bytes(bz2.compress(FASTQ.encode()))
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.gtf").write_text(GTF)
    return tmp_path


def test_fastq_by_first_bytes(spark, files):
    rows = readers.fastq(spark, [str(files / n) for n in ("a.fastq", "b.txt", "c.fastq")])
    assert rows.groupBy("file").count().filter("count = 5").count() == 3
    # three files are one stream
    assert [r.rec for r in rows.filter(F.col("file").endswith("b.txt")).orderBy("rec").collect()] == [5, 6, 7, 8, 9]
    assert readers.select_records(rows, {1, 3, 11}).count() == 3 and readers.select_records(rows, rows.filter("rec = 2")).count() == 1
    assert raw.total_size([str(files / "a.fastq")]) == (files / "a.fastq").stat().st_size
    with pytest.raises(TypeError):
        readers.fastq(spark, 3)


def test_bad_fastq(spark, tmp_path):
    (tmp_path / "bad").write_text("x\nA\n+\nI\n")
    with pytest.raises(Exception, match="doesn't start with @"):
        readers.fastq(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(Exception, match="missing"):
        readers.fastq(spark, str(tmp_path / "missing")).collect()


def test_leading_comments_only(spark, tmp_path):
    (tmp_path / "t").write_text("#a\n#b\nx\n#c\n")
    (tmp_path / "none").write_text("#a\n")
    got = readers.lines(spark, [str(tmp_path / "t"), str(tmp_path / "none")], "#").collect()
    assert [(r.rec, r.line) for r in got] == [(0, "x"), (1, "#c")]


def test_sam_fields(spark, files):
    a, b, c = readers.alignments(spark, str(files / "x.sam")).orderBy("rec").collect()
    assert (a.qname, a.flag, a.rname, a.ref_id, a.pos, a.cigar, a.CB, a.UB, a.NH, a.tags) == ("a", 0, "19", 0, 100, "2S6M100N4M", "AAAA", "CC", 1, {"XX": "left"})
    assert (b.rname, b.ref_id, b.pos, b.qual, b.CR, b.CB) == (None, -1, -1, None, "AAAA", None)
    assert c.qual == [32, 33, 34, 35, 36] and c.GE == "g1,g2"
    with pytest.raises(ValueError, match="neither"):
        readers.alignments(spark, "x.cram")
    with pytest.raises(ValueError, match="mode"):
        readers.alignments(spark, "x.sam", mode="w")


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_alignments_round_trip(spark, files, kind):
    rows = readers.alignments(spark, str(files / "x.sam"))
    sinks.alignments(rows, str(files / "out"), HEADER, kind)
    again = readers.alignments(spark, str(files / "out"), mode={"sam": "r", "bam": "rb"}[kind])
    assert again.drop("file").orderBy("rec").collect() == rows.drop("file").orderBy("rec").collect()


def test_binned_files_hold_whole_bins(spark, files):
    rows = readers.alignments(spark, str(files / "x.sam"))
    bins = grouping.split_bins(rows, ["CB", "CR"], 2, required=False)
    sinks.binned_alignments(bins, str(files / "bins"), 2, HEADER, kind="sam")
    assert readers.alignments(spark, str(files / "bins"), mode="r").count() == 2


def test_one_file_per_bin(spark, files):
    """Seven bins, one with nearly all rows and one with none: a file each, in the order of the ordinals."""
    many = spark.range(5000).select(F.col("id").alias("rec"), F.when(F.col("id") % 100 == 7, F.col("id") % 6).otherwise(2).cast("int").alias("bin"), F.concat(F.lit("q"), "id").alias("qname"))
    one = readers.alignments(spark, str(files / "x.sam")).filter("rec = 0").drop("rec", "qname")
    rows = many.crossJoin(one)
    for kind, mode in (("sam", "r"), ("bam", "rb")):
        sinks.binned_alignments(rows, str(files / kind), 7, HEADER, kind=kind)
        parts = sorted((files / kind).glob("part-*"))
        assert [int(p.name.split("-")[1]) for p in parts] == list(range(7))
        for k, p in enumerate(parts):
            names = [r.qname for r in readers.alignments(spark, str(p), mode).orderBy("rec").collect()]
            assert names == [f"q{i}" for i in range(5000) if (i % 6 if i % 100 == 7 else 2) == k]


def test_types_of_tags_stay(spark, tmp_path):
    """SAM to BAM to SAM: integers, floats, characters, hex and arrays keep their types and values."""
    tags = ["AS:i:97", "XA:A:c", "XF:Z:CODING", "XH:H:1AE3", "XI:i:-70000", "XL:i:4000000000", "XN:f:0.5", "XB:B:c,1,-2", "XC:B:f,0.5,2.0", "XZ:Z:text", "NH:i:3", "CB:Z:AC"]
    line = "a\t0\t19\t101\t60\t4M\t*\t0\t0\tACGT\tIIII\t" + "\t".join(tags)
    (tmp_path / "x.sam").write_text("\n".join([*HEADER, line]) + "\n")
    rows = readers.alignments(spark, str(tmp_path / "x.sam"))
    sinks.alignments(rows, str(tmp_path / "b"), HEADER, "bam")
    again = readers.alignments(spark, str(tmp_path / "b"), mode="rb")
    assert again.first().tag_types["XL"] == "I" and again.first().tags == rows.first().tags
    sinks.alignments(again, str(tmp_path / "s"), HEADER, "sam")
    written = next(x for p in (tmp_path / "s").glob("part-*") for x in p.read_text().splitlines() if x.startswith("a\t"))
    assert sorted(written.split("\t")[11:]) == sorted(tags) and written.split("\t")[:11] == line.split("\t")[:11]


def test_tags_without_types_are_text(spark, files):
    rows = readers.alignments(spark, str(files / "x.sam")).drop("tag_types")
    sinks.alignments(rows, str(files / "plain"), HEADER, "bam")
    again = readers.alignments(spark, str(files / "plain"), mode="rb").orderBy("rec").collect()
    assert [r.tags for r in again] == [r.tags for r in rows.orderBy("rec").collect()] and [r.NH for r in again] == [1, None, 2]


def test_gtf(spark, files):
    rows = readers.gtf(spark, str(files / "x.gtf"))
    first = rows.orderBy("rec").first()
    assert (first.seqname, first.feature, first.start, first.end, first.attributes["tag"]) == ("19", "gene", 60951, 71626, "two")
    assert [r.gene for r in genes.gene_index(rows).orderBy("gene_index").collect()] == ["mt-A", "B"]
    assert [r.gene for r in genes.mitochondrial_genes(rows).collect()] == ["G1"]
    assert genes.gene_places_sorted(rows).first().genes[0].gene == "mt-A"
    assert genes.gene_exons(rows).first().exons[0].start == 60951
    named = genes.set_attribute(rows, "tag", F.lit("new"))
    assert {r.attributes["tag"] for r in named.collect()} == {"new"} and rows.select(genes.identity(rows)).distinct().count() == 3
    assert rows.select(genes.serialised(rows).alias("t")).first().t.startswith("19\tx\tgene\t60951\t71626\t.\t-\t.\t")


def test_gene_without_name(spark, tmp_path):
    (tmp_path / "g").write_text('1\tx\tgene\t1\t2\t.\t+\t.\tgene_id "G";\n')
    with pytest.raises(Exception, match="gene without gene_name"):
        genes.gene_index(readers.gtf(spark, str(tmp_path / "g"))).collect()


def test_whitelist_and_gene_list(spark, tmp_path):
    (tmp_path / "w").write_text("AC\nGT\n")
    assert [(r.barcode, r.line_no) for r in readers.whitelist(spark, str(tmp_path / "w")).collect()] == [("AC", 0), ("GT", 1)]
    (tmp_path / "m").write_text("# c\n\nA \n")
    assert [r.gene for r in readers.gene_list(spark, str(tmp_path / "m")).collect()] == ["A"]


def test_matrices(spark, tmp_path):
    table = spark.createDataFrame([("c1", "g1", 2), ("c2", "g2", 3)], "cell string, gene string, n long")
    sinks.count_archive(table, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.count_archive(spark, str(tmp_path / "m")).collect())) == [("c1", "g1", 2), ("c2", "g2", 3)]
    (tmp_path / "x.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 2 2\n1 1 2\n2 2 3\n")
    (tmp_path / "rows").write_text("c1\nc2\n")
    (tmp_path / "cols").write_text("g1\ng2\n")
    assert sorted(map(tuple, readers.matrix_market(spark, *[str(tmp_path / n) for n in ("x.mtx", "rows", "cols")]).collect())) == [("c1", "g1", 2), ("c2", "g2", 3)]
    sinks.count_tables(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/counts")).count() == 2


def test_archives_hold_all_genes_and_stack(spark, tmp_path):
    """Rows in the order of first appearance, a column for every gene; two archives of one annotation go one after the other."""
    from cellweave.cli import main

    genes_of = spark.createDataFrame([("B", 0), ("unused", 1), ("A", 2)], "gene string, gene_index long")
    for k, cells in enumerate((["z", "a"], ["q", "a"])):
        table = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "cell string, cell_index long")
        found = spark.createDataFrame([(cells[0], "A", 2 + k), (cells[1], "B", 5), (cells[1], "A", 7)], "cell string, gene string, n long")
        sinks.count_archive(found, str(tmp_path / f"m{k}"), table, genes_of)
    dense = {"z": [0, 0, 2], "a": [5, 0, 7]}
    m = np.load(str(tmp_path / "m0.npz"))
    assert m["shape"].tolist() == [2, 3] and m["indptr"].tolist() == [0, 1, 3] and m["indices"].tolist() == [2, 0, 2] and m["data"].tolist() == [2, 5, 7]
    assert np.load(str(tmp_path / "m0_row_index.npy")).tolist() == list(dense) and np.load(str(tmp_path / "m0_col_index.npy")).tolist() == ["B", "unused", "A"]
    main(["MergeCountMatrices", "-i", str(tmp_path / "m0"), str(tmp_path / "m1"), "-o", str(tmp_path / "both")])
    m = np.load(str(tmp_path / "both.npz"))
    assert m["shape"].tolist() == [4, 3] and m["indptr"].tolist() == [0, 1, 3, 4, 6] and m["data"].tolist() == [2, 5, 7, 3, 5, 7]
    assert np.load(str(tmp_path / "both_row_index.npy")).tolist() == ["z", "a", "q", "a"]
    with pytest.raises(Exception, match="unknown gene"):
        sinks.count_archive(spark.createDataFrame([("z", "other", 1)], "cell string, gene string, n long"), str(tmp_path / "bad"), None, genes_of)


@pytest.mark.parametrize("wide", [False, True])
def test_archives_made_of_many_blocks(spark, tmp_path, monkeypatch, wide):
    """Blocks of three rows, some without entries; pointers of 64 bits from some number of entries on."""
    from cellweave.sources import archives

    monkeypatch.setattr(archives, "BLOCK_ROWS", 3)
    monkeypatch.setattr(archives, "WIDE", 5 if wide else 1 << 31)
    dense = np.random.default_rng(1).integers(0, 3, (20, 6)) * (np.arange(20)[:, None] % 4 != 1)
    dense[9:15] = 0
    rows, columns = np.nonzero(dense)
    entries = spark.createDataFrame([(int(i), int(j), int(dense[i, j])) for i, j in zip(rows, columns, strict=True)], "cell_index long, gene_index long, n long").repartition(5)
    cells = spark.createDataFrame([(f"c{'x' * (i % 3)}{i}", i) for i in range(20)], "cell string, cell_index long")
    names = spark.createDataFrame([(f"g{j}", j) for j in range(6)], "gene string, gene_index long")
    archives.write_archive(entries, cells, names, str(tmp_path / "m"))
    m = np.load(str(tmp_path / "m.npz"))
    assert m["indptr"].dtype == m["indices"].dtype == (np.int64 if wide else np.int32) and m["data"].dtype == np.uint32 and m["format"] == b"csr"
    assert m["shape"].tolist() == [20, 6] and m["indptr"].tolist() == [0, *np.cumsum((dense > 0).sum(axis=1)).tolist()]
    assert m["indices"].tolist() == columns.tolist() and m["data"].tolist() == dense[rows, columns].tolist()
    assert np.load(str(tmp_path / "m_row_index.npy")).tolist() == [f"c{'x' * (i % 3)}{i}" for i in range(20)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.npz", "m_col_index.npy", "m_row_index.npy"]
    assert {(r.cell_index, r.gene_index): r.n for r in readers.archive_entries(spark, str(tmp_path / "m")).collect()} == {(i, j): dense[i, j] for i, j in zip(rows.tolist(), columns.tolist(), strict=True)}
    empty = spark.createDataFrame([], "cell_index long, gene_index long, n long")
    archives.write_archive(empty, cells.limit(0), names.limit(0), str(tmp_path / "e"))
    assert np.load(str(tmp_path / "e.npz"))["indptr"].tolist() == [0] and np.load(str(tmp_path / "e_row_index.npy")).tolist() == []
    with pytest.raises(Exception, match="doesn't fit"):
        archives.write_archive(entries.withColumn("n", F.lit(1 << 33)), cells, names, str(tmp_path / "bad"))


def test_checksums_of_joined_bytes():
    import random
    import zlib

    from cellweave.sources.archives import joined_crc

    rng = random.Random(1)
    for _ in range(100):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_metrics_files(spark, tmp_path):
    table = spark.createDataFrame([("A", 1, 0.5), (None, 2, None)], "CB string, n_reads long, genomic_read_quality_mean double")
    path = sinks.metrics_file(table, str(tmp_path / "m"))
    assert path.endswith(".csv.gz") and gzip.decompress(Path(path).read_bytes()).decode() == ",n_reads,genomic_read_quality_mean\nA,1,0.5\nNone,2,nan\n"
    back = readers.metrics_csv(spark, path, "CB")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("A", 1, 0.5), (None, 2, None)], key=str)
    sinks.metrics_csv(table, str(tmp_path / "folder"))
    assert readers.metrics_csv(spark, str(tmp_path / "folder"), "CB").count() == 2


def test_attach(spark, files):
    reads = readers.fastq(spark, str(files / "a.fastq"))
    rows = readers.alignments(spark, str(files / "x.sam"))
    done = tagging.attach_barcodes(rows, reads, {k: v for k, v in tagging.TEN_X_V2.items() if k != "sample"})
    got = done.orderBy("rec").collect()
    assert len(got) == 3 and got[0].CR == "ACGTACGTACGTACGT" and got[0].UR == "ACGTACGTAC"
    with pytest.raises(ValueError, match="index read"):
        tagging.attach_barcodes(rows, reads, tagging.TEN_X_V2)


def _lanes(tmp_path, sizes, name, line):
    """Files of so many records each, numbered over all."""
    paths, k = [], 0
    for i, n in enumerate(sizes):
        (tmp_path / f"{name}{i}").write_text("".join(line(j) for j in range(k, k + n)))
        paths.append(str(tmp_path / f"{name}{i}"))
        k += n
    return paths


def _dna(j):
    return "".join("ACGT"[j >> 2 * i & 3] for i in range(16))


@pytest.mark.parametrize(("sizes", "sams"), [((2, 2), (4,)), ((3, 1, 5), (4, 5)), ((4, 5), (1, 7, 1)), ((6,), (2, 2, 2))])
def test_lanes_are_one_stream(spark, tmp_path, sizes, sams):
    """Several files of reads and of alignments: everything that goes by position is as in a plain loop over all of them."""
    r1 = _lanes(tmp_path, sizes, "r1_", lambda j: f"@q{j}\n{_dna(j)}ACGTACGTAC\n+\n{'I' * 26}\n")
    u2 = _lanes(tmp_path, sams, "u2_", lambda j: f"q{j}\t0\t{19 + j % 2}\t{j + 1}\t60\t4M\t*\t0\t0\tACGT\tIIII\tCB:Z:c{(j * 7) % 5}\tUB:Z:u{j}\tGE:Z:g\tXF:Z:CODING\n")
    reads, rows = readers.fastq(spark, r1), readers.alignments(spark, u2, mode="r")
    n = min(sum(sizes), sum(sams))
    done = tagging.attach_barcodes(rows, reads, {k: v for k, v in tagging.TEN_X_V2.items() if k != "sample"}).orderBy("rec").collect()
    assert [(r.rec, r.qname, r.CR) for r in done] == [(j, f"q{j}", _dna(j)) for j in range(n)]
    assert sorted(r.name for r in readers.select_records(reads, {0, 3}).collect()) == ["@q0", "@q3"]
    wanted = spark.createDataFrame([(0,), (n - 1,)], "rec long")
    assert sorted(r.qname for r in readers.select_records(rows, wanted).collect()) == sorted({"q0", f"q{n - 1}"})
    seen = list(dict.fromkeys(f"c{(j * 7) % 5}" for j in range(sum(sams))))
    assert [r.cell for r in counts.cell_index(rows).orderBy("cell_index").collect()] == seen
    some = grouping.subset(rows, 2, "19", 1).orderBy("rec").collect()
    assert [r.qname for r in some] == ["q0", "q1", "q2"]
    # the order is enough for what only needs an order
    loose = readers.alignments(spark, u2, mode="r", dense=False)
    assert [r.qname for r in loose.orderBy("rec").collect()] == [f"q{j}" for j in range(sum(sams))]
    assert [r.cell for r in counts.cell_index(loose).orderBy("cell_index").collect()] == seen
    assert loose.select("rname", "CB").count() == sum(sams)


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    reads = "".join(f"@q{j}\n{_dna(j)}\n+\n@{'I' * 15}\n" for j in range(2000))
    (tmp_path / "r").write_text(reads)
    frames = [readers.fastq(spark, str(tmp_path / "r"), split=s) for s in (1 << 30, len(reads) // 3 + 1, len(reads) // 16 + 1)]
    assert [f.rdd.getNumPartitions() for f in frames] == [1, 3, 16]
    assert {tuple(map(tuple, f.orderBy("rec").collect())) for f in frames} == {tuple((str(tmp_path / "r"), j, f"@q{j}", _dna(j), "+", "@" + "I" * 15) for j in range(2000))}
    few = readers.fastq(spark, str(tmp_path / "r"), columns=["sequence"], split=len(reads) // 4)
    assert few.columns == ["sequence"] and few.distinct().count() == 2000


def test_bad_records_go_in_step(spark, tmp_path):
    """A record that is broken in one file is left out of all, and is one row of the bad."""
    name = lambda kind, j: "" if (kind, j) in (("r1", 3), ("r2", 5), ("i1", 5)) else "@"
    paths = {kind: _lanes(tmp_path, (4, 4), kind, lambda j, kind=kind: f"{name(kind, j)}q{j}\n{_dna(j)}\n+\n{'I' * 16}\n") for kind in ("r1", "r2", "i1")}
    reads = {kind: readers.fastq(spark, p, keep_bad=True) for kind, p in paths.items()}
    kept, bad = tagging.in_step(reads)
    for kind in reads:
        assert [r.name for r in kept[kind].orderBy("rec").collect()] == [f"@q{j}" for j in (0, 1, 2, 4, 6, 7)]
    assert sorted((r.read, r.rec, r.name) for r in bad.collect()) == [("i1", 5, "q5"), ("r1", 3, "q3"), ("r2", 5, "q5")]
    assert sorted(map(tuple, tagging.bad_counts(bad).select("read", "fault", "n").collect())) == [(k, "the name doesn't start with @", 1) for k in ("i1", "r1", "r2")]


def test_one_sorted_bam_and_its_index(spark, tmp_path):
    """All partitions in one file in order, one header and one end; the index has ordinals, and what a reference needs."""
    one = lambda j: f"q{j:04d}\t0\tchr{j % 7}\t{j + 1}\t60\t400M\t*\t0\t0\t{'ACGT' * 100}\t{'I' * 400}\tCB:Z:c{j % 5}\n"
    header = ["@HD\tVN:1.6", *[f"@SQ\tSN:chr{i}\tLN:100000" for i in range(7)]]
    (tmp_path / "x.sam").write_text("\n".join(header) + "\n" + "".join(one(j) for j in range(3000)))
    rows = readers.alignments(spark, str(tmp_path / "x.sam"))
    from cellweave.sources import formats, splits

    target = str(tmp_path / "y.bam")
    stretch, formats.STRETCH = formats.STRETCH, 1000
    try:
        sinks.single_bam(rows.repartition(6).orderBy("rname", "qname"), target, header)
    finally:
        formats.STRETCH = stretch
    assert sorted(p.name for p in tmp_path.iterdir() if "y.bam" in p.name) == ["y.bam", "y.bam.index"]
    data = gzip.decompress((tmp_path / "y.bam").read_bytes())
    assert data.count(b"BAM\1") == 1 and (tmp_path / "y.bam").read_bytes().endswith(formats.BGZF_END) and (tmp_path / "y.bam").read_bytes().count(formats.BGZF_END) == 1
    wanted = [(r.rname, r.qname) for r in rows.orderBy("rname", "qname").collect()]
    for size in (1, 5000, 1 << 30):
        again = readers.alignments(spark, target, split=size)
        assert [(r.rname, r.qname) for r in again.orderBy("rec").collect()] == wanted and again.agg(F.max("rec")).first()[0] == 2999
    read = lambda found: sum((s.end or (tmp_path / "y.bam").stat().st_size) - s.begin for s in found)
    some, every = splits.indexed_splits([target], 1, "chr3"), splits.indexed_splits([target], 1)
    if len(every) > 7:  # the workers knew of the short stretch
        assert read(some) < read(every) / 2
    here = readers.alignments(spark, target, reference="chr3").orderBy("rec").collect()
    assert [(r.rec, r.rname, r.qname) for r in here] == [(k, *w) for k, w in enumerate(wanted) if w[0] == "chr3"]
    assert readers.alignments(spark, target, reference="none").count() == 0
    (tmp_path / "y.bam.index").unlink()
    assert [r.rec for r in readers.alignments(spark, target, reference="chr3", split=20_000).orderBy("rec").collect()] == [r.rec for r in here]
    sinks.single_bam(rows.limit(0), str(tmp_path / "none.bam"), header)
    assert readers.alignments(spark, str(tmp_path / "none.bam")).count() == 0


def test_fastq_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, "q", "A" * 16, "I" * 16, "C" * 10, "I" * 10, "A" * 16, "ACGT", "IIII", 1)], "file string, rec long, qname string, CR string, CY string, UR string, UY string, CB string, seq string, quality string, shard int")
    sinks.fastq_shards(rows, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/R1")).count() == 4
    sinks.downsampled_fastq(rows, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d/R1")).collect()][1] == "A" * 8 + "CTTCAGCGTTCCCGAGAG" + "A" * 6 + "C" * 10 + "T"


def test_quality_logs(spark, tmp_path):
    (tmp_path / "s1_qc.alignment_summary_metrics.txt").write_text("## h\n# c\n\n## METRICS CLASS\tpicard.analysis.AlignmentSummaryMetrics\nCATEGORY\tTOTAL_READS\tSAMPLE\nFIRST_OF_PAIR\t10\t\nPAIR\t20\t\n\n## HISTOGRAM\tx\n1\t2\n")
    (tmp_path / "s1_qc.insert_size_metrics.txt").write_text("## METRICS CLASS\tpicard.analysis.InsertSizeMetrics\nMEDIAN\tLIBRARY\n191\t\n5\t\n\n")
    files = qc.whole_files(spark, [str(tmp_path / "*metrics.txt")])
    got = {r.metric: r.value for r in qc.picard_metrics(files).collect()}
    assert got == {"TOTAL_READS.FIRST_OF_PAIR": "10", "TOTAL_READS.PAIR": "20", "MEDIAN": "191"}
    assert qc.with_classes(qc.picard_metrics(files)).collect()[0].sample == "Class"
    table = qc.picard_table(qc.whole_files(spark, [str(tmp_path / "*insert*")]))
    assert table.columns == ["Sample", "MEDIAN", "LIBRARY"] and [r.MEDIAN for r in table.collect()] == ["191", "5"]
    (tmp_path / "s1_qc.log").write_text("HISAT2 summary stats:\n\tTotal pairs: 5479\n\t\tAligned 0 time: 412 (7.52%)\n")
    got = {(r["class"], r.metric): r.value for r in qc.hisat2_metrics(qc.whole_files(spark, [str(tmp_path / "s1_qc.log")])).collect()}
    assert got == {("HISAT2G", "Total pairs"): "5479", ("HISAT2G", "Aligned 0 time"): "412"}
    (tmp_path / "s1_rsem.cnt").write_text("1 2 0 3\n4 5 6\n7 3\n0\t1\n")
    got = {r.metric: r.value for r in qc.rsem_metrics(qc.whole_files(spark, [str(tmp_path / "s1_rsem.cnt")])).collect()}
    assert got["total reads"] == "3" and got["uncertain reads"] == "6" and got["strand"] == "3" and len(got) == 9
