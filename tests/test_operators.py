from collections import Counter, defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import sequence as seq
from cellweave.operators import barcodes, counts, genes, grouping, metrics, tagging
from cellweave.schema import CELL_METRICS, COMMON_METRICS, GENE_METRICS

READ = "rec long, qname string, flag int, rname string, pos int, cigar string, CB string, CR string, CY string, UB string, UR string, UY string, GE string, XF string, NH int, qual array<int>"


def read(rec, **k):
    base = {"qname": f"q{rec}", "flag": 0, "rname": "1", "pos": 5, "cigar": "4M", "CB": "A", "CR": "A", "CY": "I", "UB": "C", "UR": "C", "UY": "I", "GE": "g", "XF": "CODING", "NH": 1, "qual": [40, 40, 20, 20]} | k
    return (rec, *[base[f.split()[0]] for f in READ.split(", ")[1:]])


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_read_structure():
    assert seq.read_structure("8C18X6C9M1X") == [("C", 0, 8), ("X", 8, 26), ("C", 26, 32), ("M", 32, 41), ("X", 41, 42)]
    with pytest.raises(ValueError):
        seq.read_structure("8C3")


def test_slices_past_the_end(spark):
    assert scalar(spark, seq.between(F.lit("ACGT"), 2, 9)) == "GT"
    assert scalar(spark, seq.between(F.lit("ACGT"), 6, 9)) == ""
    with pytest.raises(ValueError):
        seq.between(F.lit("A"), 3, 2)


def test_qualities(spark):
    assert scalar(spark, seq.phred(F.lit("!I"))) == [0, 40]
    assert scalar(spark, seq.mean_quality(F.lit("!I"))) == 20.0
    assert scalar(spark, seq.mean_quality(F.lit(""))) is None
    assert scalar(spark, seq.share_above(F.lit([30, 31, 40, 2]))) == 0.5
    assert scalar(spark, seq.share_above(F.array().cast("array<int>"))) is None
    for text in ("!?@I", "I", "", "?", "@@"):
        assert scalar(spark, seq.share_above_text(F.lit(text))) == scalar(spark, seq.share_above(seq.phred(F.lit(text))))
    quals = F.lit(list(range(10)))
    assert scalar(spark, seq.aligned_part(quals, F.lit("2S6M2S"))) == [2, 3, 4, 5, 6, 7]
    assert scalar(spark, seq.aligned_part(quals, F.lit("3H10M"))) == list(range(10))
    assert scalar(spark, seq.aligned_part(quals, F.lit("1H1S9M"))) == list(range(1, 10))
    assert scalar(spark, seq.aligned_part(quals, F.lit("20S"))) == []
    assert [scalar(spark, seq.spliced(F.lit(c))) for c in ("5M10N5M", "5M0N5M", "10M", None)] == [True, False, False, False]


def test_encodings(spark):
    for text in ("ACGT", "TTTGGG", "A", "C" * 31):
        code = seq.encode_two_bit(F.lit(text))
        assert scalar(spark, seq.decode_two_bit(code, len(text))) == text
        assert scalar(spark, seq.gc_count_encoded(code, 2)) == sum(c in "GC" for c in text) == scalar(spark, seq.gc_count(F.lit(text)))
    assert scalar(spark, seq.encode_two_bit(F.lit("AN"))) is None
    assert scalar(spark, seq.encode_two_bit(F.lit("AN"), seed=1)) in range(4)
    for text in ("ACGTN", "N" * 21):
        assert scalar(spark, seq.decode_three_bit(seq.encode_three_bit(F.lit(text)))) == text
    assert scalar(spark, seq.decode_three_bit(seq.encode_three_bit(F.lit("axT")))) == "ANT"
    a, b = "ACGTACGT", "ACCTACGA"
    for encode, bits in ((seq.encode_two_bit, 2), (seq.encode_three_bit, 3)):
        assert scalar(spark, seq.hamming_encoded(encode(F.lit(a)), encode(F.lit(b)), bits)) == 2
    assert scalar(spark, seq.hamming(F.lit(a), F.lit(b))) == 2
    assert scalar(spark, seq.hamming(F.lit("A"), F.lit("AC"))) is None


def test_entropy(spark):
    assert scalar(spark, seq.entropy4(*[F.lit(0.25)] * 4)) == pytest.approx(1)
    assert scalar(spark, seq.entropy4(F.lit(1.0), *[F.lit(0.0)] * 3)) == pytest.approx(0)


def test_tags(spark):
    null = F.lit(None).cast("string")
    assert scalar(spark, seq.tag_or(F.lit("-"), "x", dash_is_missing=True)) == "x" and scalar(spark, seq.tag_or(null, "x")) == "x"
    assert scalar(spark, seq.first_tag(null, F.lit("b"))) == "b"
    with pytest.raises(Exception, match="without any of the tags"):
        scalar(spark, seq.first_tag(null, required=True))


def test_last_barcode_wins_even_over_an_exact_one(spark):
    wl = spark.createDataFrame([("AAAA", 0), ("AAAT", 1)], "barcode string, line_no long")
    rows = spark.createDataFrame([("AAAA",), ("AAAT",), ("NAAA",), ("GGGG",), ("AAA",), (None,)], "CR string")
    got = {r.CR: r.CB for r in barcodes.correct(rows, wl).collect()}
    assert got == {"AAAA": "AAAT", "AAAT": "AAAT", "NAAA": "AAAA", "GGGG": None, "AAA": None, None: None}
    got = {r.CR: r.CB for r in barcodes.correct(rows, wl, fall_back=True).collect()}
    assert got["GGGG"] == "GGGG"
    tally = barcodes.correction_tally(barcodes.correct(rows, wl).withColumn("file", F.lit("f")), "file").first()
    assert (tally.n_reads, tally.n_correct, tally.n_corrected, tally.n_uncorrectable) == (6, 1, 2, 3)


def test_barcode_sets(spark):
    rows = spark.createDataFrame([("AC",), ("AC",), ("GC",)], "barcode string")
    freq = {r.pos: (r.A, r.C, r["T"], r.G) for r in barcodes.base_frequency(rows).collect()}
    assert freq == {0: (1, 0, 0, 1), 1: (0, 2, 0, 0)}
    with pytest.raises(NotImplementedError):
        barcodes.base_frequency(rows, weighted=True)
    pwm = {r.position: (r.A, r.G) for r in barcodes.position_weights(spark.createDataFrame([("aX",), ("GN",)], "s string"), "s").collect()}
    assert pwm == {1: (1, 1), 2: (0, 0)}
    assert barcodes.hamming_summary(rows).first().minimum == 1.0
    assert [r.barcode for r in barcodes.counts_descending(rows, "barcode").collect()] == ["AC", "GC"]


def test_metrics_by_hand(spark):
    rows = [
        read(0), read(1), read(2, UB="T", UR="C", flag=16), read(3, flag=4, NH=None, XF=None, rname=None, pos=-1),
        read(4, CB=None, GE="h"), read(5, GE="a,b", XF="INTERGENIC", NH=3, flag=1024, cigar="2M5N2M"), read(6, GE=None, UB=None),
    ]
    df = spark.createDataFrame(rows, READ)
    mito = spark.createDataFrame([("g",)], "gene string")
    cells = {r.CB: r for r in metrics.cell_metrics(df, mito).collect()}
    a = cells["A"]
    assert set(cells) == {"A", None}
    assert (a.n_reads, a.n_molecules, a.n_fragments, a.n_genes) == (6, 4, 4, 3)
    assert (a.perfect_molecule_barcodes, a.perfect_cell_barcodes, a.reads_mapped_exonic, a.reads_unmapped, a.reads_mapped_intergenic) == (4, 6, 4, 1, 1)
    assert (a.reads_mapped_uniquely, a.reads_mapped_multiple, a.duplicate_reads, a.spliced_reads) == (4, 1, 1, 1)
    assert (a.fragments_with_single_read_evidence, a.molecules_with_single_read_evidence) == (3, 3)
    assert (a.n_mitochondrial_genes, a.n_mitochondrial_molecules) == (1, 4) and a.pct_mitochondrial_molecules == pytest.approx(400 / 6)
    assert a.genomic_read_quality_mean == 30 and a.genomic_reads_fraction_bases_quality_above_30_mean == 0.5
    assert cells[None].genomic_read_quality_variance is None and cells[None].perfect_cell_barcodes == 0
    assert metrics.cell_metrics(df).columns == ["CB", *COMMON_METRICS, *CELL_METRICS]
    assert metrics.cell_metrics(df, drop_null=True).count() == 1
    by_gene = {r.GE: r for r in metrics.gene_metrics(df).collect()}
    assert set(by_gene) == {"g", "h", None} and by_gene["g"].number_cells_expressing == 1 and by_gene["g"].number_cells_detected_multiple == 1
    assert metrics.gene_metrics(df).columns == ["GE", *COMMON_METRICS, *GENE_METRICS]
    assert metrics.cell_metrics(df.limit(0)).count() == 0
    more = metrics.cell_metrics(df, extra={"last_pos": F.max("pos")})
    assert more.columns[-1] == "last_pos" and {r.last_pos for r in more.collect()} == {5}


def test_merged_means_keep_what_is_missing(spark):
    one = spark.createDataFrame([read(0), read(1, qual=[10, 10, 10, 10])], READ)
    other = spark.createDataFrame([read(2)], READ)
    chunks = [metrics.gene_metrics(x) for x in (one, other)]
    m = metrics.merge_gene_metrics(*chunks).first()
    assert m.n_reads == 3 and m.genomic_read_quality_mean == pytest.approx((20 * 2 + 30) / 3)
    assert m.genomic_read_quality_variance is None  # the second chunk has none
    assert metrics.merge_gene_metrics(chunks[0]) is chunks[0]


def test_counts_against_a_loop(spark):
    random = Random(777)
    rows, rec = [], 0
    for q in range(400):
        cell, molecule = random.choice(["c1", "c2", None]), random.choice(["m1", "m2", "m3", None])
        for _ in range(random.randint(1, 3)):
            gene = random.choice(["g1", "g2", "g3", "g1,g2", None])
            rows.append(read(rec, qname=f"q{q}", CB=cell, UB=molecule, GE=gene, XF=random.choice(["CODING", "INTERGENIC", None, "EXONIC"])))
            rec += 1
    queries = defaultdict(list)
    names = [f.split()[0] for f in READ.split(", ")]
    for r in rows:
        queries[r[1]].append(dict(zip(names, r, strict=True)))
    wanted, seen, order = Counter(), set(), {}
    for alignments in queries.values():
        found = {a["GE"] for a in alignments if a["GE"] and "," not in a["GE"] and a["XF"] and a["XF"] != "INTERGENIC"}
        first = alignments[0]
        if len(found) == 1 and first["CB"] and first["UB"]:
            key = (first["CB"], first["UB"], *found)
            order.setdefault(first["CB"], len(order))
            if key not in seen:
                seen.add(key)
                wanted[first["CB"], *found] += 1
    df = spark.createDataFrame(rows, READ)
    assert {(r.cell, r.gene): r.n for r in counts.count_matrix(df).collect()} == dict(wanted)
    assert {r.cell: r.cell_index for r in counts.cell_index(df).collect()} == order
    index = spark.createDataFrame([("g1", 0)], "gene string, gene_index long")
    assert {r.gene for r in counts.count_matrix(df, index).collect()} == {"g1"}
    with pytest.raises(Exception, match="unknown gene"):
        counts.count_matrix(df, index, strict=True).collect()


@pytest.mark.parametrize("width", [1, 2, 3, 1 << 20])
def test_runs(spark, width):
    tags = ["a", "a", None, None, "a", "b"]
    df = spark.createDataFrame([(f, i, t) for f in ("x", "y") for i, t in enumerate(tags)], "file string, rec long, t string")
    wanted = [(f, *run) for f in ("x", "y") for run in ((1, "a", 2), (2, None, 2), (3, "a", 1), (4, "b", 1))]
    assert [(r.file, r.run, r.t, r.n) for r in grouping.run_sizes(df, "t", width=width).orderBy("file", "run").collect()] == wanted
    assert grouping.run_groups(df, "t", drop_null=True, width=width).count() == 8
    assert grouping.run_sizes(df.limit(0), "t", width=width).count() == 0
    assert grouping.run_groups(df, "t").columns == ["file", "rec", "t", "run"]


def test_stretches_hand_on_in_stretches(spark, monkeypatch):
    """Runs and rows before, against one loop over each file; no task orders a row of each stretch of a file: these are dealt out in turn."""
    import random

    rng = random.Random(5)
    recs = {f: sorted(rng.sample(range(400), 90)) for f in ("x", "y", None)}
    rows = [(f, i, rng.choice(["a", "a", "b", None])) for f, all_of in recs.items() for i in all_of]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, rec long, t string").repartition(3)
    runs, before = {}, {}
    for f in recs:
        last, n = (), 0
        for _, i, t in sorted(r for r in rows if r[0] == f) if f else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            n += last != (t,)
            runs[f, i], before[f, i] = n, last
            last = (t,)
    ordered = []  # rows of the windows that are over whole files
    for name in ("_previous", "_starts"):
        inner = getattr(grouping, name)

        def seen(parts, *rest, inner=inner):
            if not rest[-1]:
                ordered.append(parts.count())
            return inner(parts, *rest)

        monkeypatch.setattr(grouping, name, seen)
    for width, handed in ((1, 2), (2, 50), (7, 3), (1 << 20, 1 << 12)):
        monkeypatch.setattr(grouping, "HANDED", handed)
        assert {(r.file, r.rec): r.run for r in grouping.run_groups(df, "t", width=width).collect()} == runs
        assert {(r.file, r.rec): tuple(r.before or ()) for r in grouping.with_previous(df, F.col("t"), width=width).collect()} == before
        assert len(ordered) == 2 and max(ordered) <= 3 * (400 // (width * handed) + 1)
        ordered.clear()


def test_sorting(spark):
    df = spark.createDataFrame([("f", i, q, t) for i, (q, t) in enumerate([("x", "b"), ("y", "a"), ("a", None), ("a", "a")])], "file string, rec long, qname string, CB string")
    assert [(r.qname, r.CB) for r in grouping.tag_sort(df, ["CB"]).collect()] == [("a", None), ("a", "a"), ("y", "a"), ("x", "b")]
    with pytest.raises(grouping.SortError):
        grouping.verify_sort(df, ["CB"])
    for width in (1, 2, 100):
        assert [r.rec for r in grouping.out_of_order(df, ["CB"], width=width).orderBy("rec").collect()] == [1, 2]
    grouping.verify_sort(df.limit(1), ["CB"])
    with pytest.raises(ValueError):
        grouping.tag_order("XYZ")
    with pytest.raises(ValueError):
        grouping.sort_keys([])


@pytest.mark.parametrize("order", grouping.TAG_ORDERS)
def test_places_in_tag_order(spark, order):
    rng = Random(order)
    some = [(k, f"q{rng.randrange(9)}", *[rng.choice([None, "", "a", "b"]) for _ in range(3)], "x") for k in range(300)]
    df = spark.createDataFrame(some, "rec long, qname string, CB string, UB string, GE string, _place string").repartition(5)
    tags = grouping.tag_order(order)
    placed = grouping.tag_places(df, tags)
    assert placed.columns == [*df.columns, "place"]
    wanted = sorted(some, key=lambda r: (*[r[df.columns.index(t)] or "" for t in tags], r[1], r[0]))
    assert [tuple(r) for r in placed.orderBy("place").collect()] == [(*r, k) for k, r in enumerate(wanted)]
    assert [r.rec for r in grouping.tag_sort(df, tags).collect()] == [r[0] for r in wanted]
    assert grouping.tag_places(df.limit(0), tags).isEmpty()


def test_splitting(spark):
    df = spark.createDataFrame([(i, f"c{i % 5}" if i % 7 else None) for i in range(100)], "rec long, CB string")
    bins = grouping.split_bins(df, ["CB"], 3, required=False)
    assert bins.groupBy("CB").agg(F.count_distinct("bin").alias("n")).filter("n > 1").count() == 0 and bins.count() == 85
    with pytest.raises(Exception, match="without any of the tags"):
        grouping.split_bins(df, ["CB"], 3).collect()
    assert grouping.parts_of(2500) == 3
    with pytest.raises(ValueError):
        grouping.parts_of(2_000_000)
    with pytest.warns(UserWarning):
        grouping.parts_of(600_000)


def test_dense_index_over_many_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(13)
    assert [(r.v, r.i) for r in counts.dense_index(df, ["v"], "i").orderBy("v").collect()] == [(i, i) for i in range(1000)]


def test_intervals_are_open(spark):
    points = spark.createDataFrame([("1", a) for a in (10, 11, 19, 20)], "chromosome string, at int")
    intervals = spark.createDataFrame([("1", 10, 20, "g"), ("2", 0, 99, "h")], "chromosome string, start int, end int, gene string")
    for width in (1, 7, 100):
        assert sorted(r.at for r in genes.containing(points, intervals, width).collect()) == [11, 19]
    with pytest.raises(Exception, match="ends before"):
        scalar(spark, genes.size(F.lit(3), F.lit(2)))


def test_layouts():
    assert tagging.layout((0, 16), (16, 10))["molecule"] == tagging.Embedded(16, 26, "UR", "UY")
    for bad in ({"cell": (0, None)}, {"cell": (-1, 4)}, {"cell": (0, 0)}, {"cell": (0, 8), "molecule": (4, 4)}, {"sample": (0, 8)}, {}):
        with pytest.raises(ValueError):
            tagging.layout(**bad)


def test_zip_is_as_long_as_the_shortest(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(4)], "rec long, x string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3)], "rec long, x string")
    assert [r.x for r in tagging.zipped(a, b).orderBy("rec").collect()] == ["b0", "b1", "b2"]
    assert [r.rec for r in tagging.zipped(a, b, indices=[1]).collect()] == [1]
    with pytest.raises(TypeError):
        tagging.extract(a, tagging.Embedded(0, 1, "CR", "CY"))


def test_dense_index_numbers_every_row(spark):
    """Two million rows with a payload, several coalesced parts, and columns of the names used inside."""
    for n, advisory in ((2_000_000, "64m"), (400_000, "1m")):
        before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        try:
            rows = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.lit("payload").alias("part"), F.col("id").alias("k"), F.lit(1).alias("its"), F.lit(2).alias("start"))
            done = counts.dense_index(rows, ["x"], "number")
            assert done.columns == [*rows.columns, "number"]
            got = done.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("number") != F.col("x")).alias("wrong"), F.count_distinct("number").alias("distinct")).first()
            assert (got.n, got.wrong, got.distinct) == (n, 0, n)
        finally:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert counts.dense_index(spark.range(0), ["id"], "number").count() == 0


def test_dense_index_of_ties(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert sorted((r.number, r.x or "") for r in counts.dense_index(rows, ["x"], "number").collect()) == [(0, ""), (1, "a"), (2, "b"), (3, "b")]


def test_shared_folder_is_asked_for_off_local(spark, monkeypatch):
    from cellweave import shared

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_folder(Session)
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_long_barcodes_are_joined_by_shuffle(spark, monkeypatch):
    """The bound of the broadcast follows the barcodes' length."""
    whitelist = spark.createDataFrame([("A" * 24, 0)], "barcode string, line_no long")
    reads = spark.createDataFrame([("A" * 23 + "C",)], "CR string")
    monkeypatch.setattr(barcodes, "BROADCAST_ROWS", 100)
    assert "broadcast" not in str(barcodes.correct(reads, whitelist)._jdf.queryExecution().analyzed()).lower()
    assert barcodes.correct(reads, whitelist).first().CB == "A" * 24
    monkeypatch.setattr(barcodes, "BROADCAST_ROWS", 121)
    assert "broadcast" in str(barcodes.correct(reads, whitelist)._jdf.queryExecution().analyzed()).lower()


def test_short_barcodes_have_few_variants(spark, monkeypatch):
    """However long a whitelist is, of letters of the alphabet there are only so many texts of a length: they are broadcast, and reads neither shuffled nor read twice."""
    from itertools import product

    white = ["".join(p) for p in product("ACGT", repeat=3)]
    whitelist = spark.createDataFrame([(b, i) for i, b in enumerate(white * 5)] + [(None, 999)], "barcode string, line_no long")
    reads = spark.createDataFrame([(r,) for r in ("ACG", "NAC", "NNC", "AC", None)], "CR string")
    wanted = {r.CR: r.CB for r in barcodes.correct(reads, whitelist, most=0).collect()}
    assert wanted == {"ACG": "TCG", "NAC": "TAC", "NNC": None, "AC": None, None: None}
    monkeypatch.setattr(barcodes, "BROADCAST_ROWS", 125)
    assert "broadcast" in str(barcodes.correct(reads, whitelist)._jdf.queryExecution().analyzed()).lower()
    assert {r.CR: r.CB for r in barcodes.correct(reads, whitelist).collect()} == wanted
    # other letters can stay, so there is no such bound
    monkeypatch.setattr(barcodes, "BROADCAST_ROWS", 125 + 15)
    odd = whitelist.unionByName(spark.createDataFrame([("xCG", 1000)], "barcode string, line_no long"))
    assert "broadcast" not in str(barcodes.correct(reads, odd)._jdf.queryExecution().analyzed()).lower()


def test_only_the_corpus_folders_know_the_corpus_operators():
    """Nothing in the library but the subpackage itself imports it."""
    import re
    from pathlib import Path

    import cellweave

    root = Path(cellweave.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p


def test_barcodes_are_a_mapping(spark):
    rows = spark.createDataFrame([("ACGT",), ("ACGA",), ("ACGT",), (None,)], "barcode string")
    found = barcodes.Barcodes.from_rows(rows, 4)
    assert len(found) == 2 and sorted(found) == ["ACGA", "ACGT"] and found["ACGT"] == 2 and "ACGA" in found and "TTTT" not in found
    with pytest.raises(KeyError):
        found["TTTT"]
    for bad in (0, -1, "4", True):
        with pytest.raises(ValueError):
            barcodes.Barcodes.from_rows(rows, bad)
    assert found.base_frequency().filter("pos = 3").first().asDict() == {"pos": 3, "A": 1, "C": 0, "T": 1, "G": 0}
    assert found.hamming_summary().first().average == 1.0 and found.effective_diversity().filter("pos = 0").first().diversity == 0.0


def test_halves_find_what_variants_do(spark):
    """Corrections by halves of barcodes against those by the table of all variants: collisions, N, other letters, other lengths."""
    import random

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    white = [text(n) for n in (1, 2, 5, 5, 6, 30) for _ in range(15)] + ["AXGTA", "ACGTACGTAC", "ACGTACGTAG", "acgta"]
    raw = set(white)
    for w in list(white):
        for _ in range(6):
            chars = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                chars[rng.randrange(len(chars))] = rng.choice("ACGTNRx")
            raw.add("".join(chars))
    raw |= {"", "A" * 40, "N" * 5}
    whitelist = spark.createDataFrame(list(enumerate(rng.sample(white, len(white)))), "line_no long, barcode string").repartition(3)
    reads = spark.createDataFrame([(r,) for r in raw] * 2 + [(None,)], "CR string")
    for fall_back in (False, True):
        a, b = (sorted(map(str, barcodes.correct(reads, whitelist, fall_back=fall_back, most=most).collect())) for most in (10**6, 0))
        assert a == b and len(a) == 2 * len(raw) + 1


def test_distances_by_tiles(spark):
    """Every pair once, whatever the tiles; texts with other letters, too; no nested loop in the plan."""
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    words = {"".join(rng.choice("ACGT") for _ in range(n)) for n in (4, 7, 31, 40) for _ in range(25)} | {"ACGN", "ANGN", "acgt"}
    wanted = Counter(sum(x != y for x, y in zip(a, b, strict=True)) for a, b in combinations(words, 2) if len(a) == len(b))
    rows = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "barcode string")
    for tile in (1, 10, 1000):
        found = barcodes.distance_counts(rows, tile=tile)
        assert {r.d: r.n for r in found.collect()} == wanted
        assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_barcodes_of_files_and_codes(spark, tmp_path):
    (tmp_path / "w").write_text("ACGT\nACGA\nACGT\n")
    found = barcodes.Barcodes.from_whitelist(spark, str(tmp_path / "w"), 4)
    assert len(found) == 2 and found["ACGT"] == 2 and "ACGA" in found
    frame = spark.createDataFrame([("ACGT",), ("ACGT",), ("TTTT",)], "b string")
    for bits, encode in ((2, seq.encode_two_bit), (3, seq.encode_three_bit)):
        coded = barcodes.Barcodes.from_encoded(frame.select(encode(F.col("b")).alias("code")), 4, bits=bits)
        assert sorted(coded) == ["ACGT", "TTTT"] and coded["ACGT"] == 2
    with pytest.raises(ValueError):
        barcodes.Barcodes.from_encoded(frame, 4, bits=4)


def test_strict_metrics_need_their_tags(spark):
    fine = [read(0), read(1, flag=4, XF=None, NH=None)]
    for rows, tag in ((fine, None), ([*fine, read(2, UY=None)], "UY"), ([*fine, read(2, CY=None)], "CY"), ([*fine, read(2, XF=None)], "XF"), ([*fine, read(2, NH=None)], "NH")):
        df = spark.createDataFrame(rows, READ)
        assert metrics.cell_metrics(df).count() == 1
        if tag is None:
            assert metrics.cell_metrics(df, strict=True).first().n_reads == 2 and metrics.gene_metrics(df, strict=True).count() == 1
        else:
            with pytest.raises(Exception, match=f"q2 without tag {tag}"):
                metrics.cell_metrics(df, strict=True).collect()


@pytest.mark.parametrize("held", [100_000, 3])
@pytest.mark.parametrize("pieces", [1, 4, 40])
def test_metrics_of_sorted_alignments(spark, monkeypatch, held, pieces):
    """As without the order, however the sorted rows are cut into partitions and batches; molecules, cells and nulls go on over the edges."""
    from cellweave.operators import ordered

    rng = Random(held)
    rows = []
    for rec in range(900):
        cell, molecule, gene = (rng.choice(x) for x in (["A", "C", "G", None], ["AA", "CC", "T", None], ["g1", "g2", "g2,g3", None]))
        rows.append(read(rec, CB=cell, UB=molecule, GE=gene, pos=rng.randrange(3), rname=rng.choice("12"), flag=rng.choice([0, 16, 4]), XF=rng.choice(["CODING", None, "INTERGENIC"])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    monkeypatch.setattr(ordered, "HELD", held)
    by = {c: i for i, c in enumerate(f.split()[0] for f in READ.split(", "))}
    try:
        for order, f in ((("CB", "UB", "GE"), metrics.cell_metrics), (("GE", "CB", "UB"), metrics.gene_metrics)):
            lined = sorted(rows, key=lambda r: tuple((r[by[t]] or "").encode() for t in order))  # noqa: B023
            df = spark.createDataFrame(spark.sparkContext.parallelize(lined, pieces), READ)
            assert df.rdd.getNumPartitions() == pieces
            got, wanted = (sorted(map(str, frame.collect())) for frame in (f(df, order=order), f(df)))
            assert got == wanted
        with pytest.raises(Exception, match="sorted by"):
            metrics.cell_metrics(spark.createDataFrame(spark.sparkContext.parallelize(lined, pieces), READ), order=("CB", "UB", "GE")).collect()
        assert metrics.cell_metrics(df.limit(0), order=("CB", "UB", "GE")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
