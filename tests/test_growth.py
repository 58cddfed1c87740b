"""Work and files that grow with the input: what a task, a file or a state holds stays bounded."""

import pickle
from datetime import datetime

from cellweave.streaming import molecules


def test_states_are_parts_not_keys(spark, tmp_path):
    rows = [(datetime(2024, 1, 1), f"c{i}", "a") for i in range(300)]
    schema = "ts timestamp, CB string, UB string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    made = molecules.molecule_increments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["CB"], "UB", parts=4)
    running = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    running.processAllAvailable()
    states = max(p.stateOperators[0].numRowsTotal for p in running.recentProgress if p.stateOperators)
    running.stop()
    assert states <= 4 and spark.read.parquet(str(tmp_path / "out")).groupBy().sum("n").first()[0] == 300


def test_tasks_get_their_own_split_only(tmp_path):
    from cellweave.sources.formats import SplitReader
    from cellweave.sources.splits import Split, dumped

    known = [Split(str(tmp_path / f"{k}"), k) for k in range(1000)]
    reader = SplitReader("lines", {"paths": '["x"]', "splits": dumped(known)}, ["line"])
    assert len(reader.partitions()) == 1000 and len(pickle.dumps(reader)) < 1000


def test_files_and_splits_grow_with_the_input(spark, tmp_path, monkeypatch):
    from cellweave.plans import reads

    monkeypatch.setattr(reads, "FILE_ROWS", 1000)
    assert reads.pieces(spark, "/root/testdata/sf0.001", 2) >= 6
    (tmp_path / "a").write_bytes(bytes(48 << 20))
    assert reads.split_bytes(str(tmp_path / "a")) == 1 << 20


def test_lanes_grow_with_the_input(spark, monkeypatch):
    from cellweave.plans import queries, reads

    given = []
    lanes = queries._lanes
    monkeypatch.setattr(reads, "FILE_ROWS", 1000)
    monkeypatch.setattr(queries, "_lanes", lambda rows, path, n, *more: given.append(n) or lanes(rows, path, n, *more))
    queries.attach_lanes(spark, "/root/testdata/sf0.001")
    assert given == [6]


def test_batches_are_encoded_as_rows_are():
    import pyarrow as pa

    from cellweave.sources import formats

    fields = [("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("CB", pa.string()), ("NH", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("tag_types", pa.map_(pa.string(), pa.string()))]
    rows = []
    for i in range(600):
        seq = "ACGTN"[: i % 6]
        values = (f"q{i}", i % 5 * 4, ("A", "N", None)[i % 3], (-1, 7, 70000)[i % 3], 60, ("12M", "6M100N6M", None)[i % 3], (None, "=", "N")[i % 3], -1, 0, seq or None, None if i % 7 == 0 else [30] * len(seq), None if i % 2 else "AC", (None, 1, 300)[i % 3], (None, [], [("AS", "5"), ("XX", "v")])[i % 3], (None, [("AS", "i")])[i % 2])
        rows.append(dict(zip([n for n, _ in fields], values, strict=True)))
    batch, numbers = pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields)), {"A": 0, "N": 1}
    assert formats.bam_records(batch, numbers, formats.bam_tag).to_pylist() == [formats.bam_record(r, numbers) for r in batch.to_pylist()]
    assert formats.sam_array(batch).to_pylist() == [formats.sam_line(r).encode() + b"\n" for r in batch.to_pylist()]


def test_tiles_are_compared_by_tasks_of_their_own(spark):
    from itertools import combinations

    from cellweave.operators import barcodes

    texts = ["".join("ACGT"[(i * i * 7 + i * k) >> k & 3] for k in range(6)) for i in range(120)] + ["ACGT", "ACGA", "ACN", "ACG"]
    wanted: dict[int, int] = {}
    for a, b in combinations(sorted(set(texts)), 2):
        if len(a) == len(b):
            d = sum(x != y for x, y in zip(a, b, strict=True))
            wanted[d] = wanted.get(d, 0) + 1
    rows = spark.createDataFrame([(t,) for t in texts], "barcode string")
    assert {r.d: r.n for r in barcodes.distance_counts(rows, tile=16).collect()} == wanted
    code = spark.createDataFrame([(f"{i:016b}".translate({48: "A", 49: "C"}),) for i in range(64)], "barcode string")
    plan = barcodes.distance_counts(code, tile=16)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_bins_of_several_files(spark, tmp_path):
    from cellweave.plans.files import HEADER, _full
    from cellweave.sources import sinks

    rows = _full(spark, "/root/testdata/sf0.001").selectExpr("*", "CAST(pos % 2 AS INT) AS bin")
    sinks.binned_alignments(rows, str(tmp_path / "b"), 2, HEADER, files=3)
    assert sorted({int(p.name.split("-")[1]) for p in (tmp_path / "b").glob("part-*.bam")}) == list(range(6))


def test_places_of_kept_columns(spark):
    from cellweave.operators import grouping

    rows = spark.createDataFrame([(1, "q", "B", None, "g"), (2, "p", "A", "u", "g"), (3, "p", None, "u", "g")], "rec long, qname string, CB string, UB string, GE string")
    got = grouping.tag_places(rows, ["CB", "UB"], keep=["rec"])
    assert got.columns == ["rec", "place"] and sorted(map(tuple, got.collect())) == [(1, 2), (2, 1), (3, 0)]


def _shuffled(spark) -> int:
    """Bytes of shuffle files that are there; those that go may take a moment."""
    import time

    found = []
    for _ in range(10):
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        found.append(sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")))
        time.sleep(0.3)
    return min(found)


def test_orders_leave_no_shuffle_files(spark):
    from cellweave.plans import queries

    before = _shuffled(spark)
    found = queries.tag_order_permutations(spark, "/root/testdata/sf0.001")
    assert _shuffled(spark) - before < 10_000
    assert found.count() == 6 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_narrow_rows_are_sorted_as_alignments_are(spark):
    from cellweave.operators import grouping
    from cellweave.plans import reads

    rows, narrow = reads.alignments(spark, "/root/testdata/sf0.001"), reads.based(spark, "/root/testdata/sf0.001")
    for tags in (["CB", "UB", "GE"], ["GE", "CB"]):
        sort = grouping.tag_sort(narrow, tags, reads.made())
        assert sort.columns == rows.columns and sort.collect() == grouping.tag_sort(rows, tags).collect()
        above, below = sort._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
        assert "AS qual" in above and "AS qual" not in below


def test_places_are_written_as_batches(spark, monkeypatch):
    """Odd names and types, parts without rows, nulls."""
    from cellweave.operators import counts

    written = []
    once = counts.written_once
    monkeypatch.setattr(counts, "written_once", lambda df: written.append(once(df)) or written[-1])
    rows = spark.range(0, 50_000, 1, 7).filter("id < 20000 OR id > 40000").selectExpr("id AS `a.b`", "if(id % 3 = 0, null, map('k', id)) AS m", "id AS `A.C`")
    got = counts.placed(rows, "place").collect()
    assert [r.place for r in sorted(got, key=lambda r: r[0])] == list(range(len(got))) and len(got) == 20_000 + 9_999
    assert all(r[1] == (None if r[0] % 3 == 0 else {"k": r[0]}) and r[2] == r[0] for r in got)
    assert written[0].count() < 20
    assert counts.placed(rows.limit(0), "place").isEmpty()


def test_sorted_files_leave_no_shuffle_files(spark):
    """What is sorted and written is narrow before, and its shuffle files don't wait beside the file."""
    from cellweave.plans import files

    left, seen = _shuffled(spark), []
    for query, tags in ((files.sorted_file_metrics, ["CB", "UB", "GE"]), (files.one_sorted_bam, ["CB", "UB"])):
        with files.folder(spark) as path:
            target = files._sorted_bam(spark, "/root/testdata/sf0.001", path, tags)
            seen.append(_shuffled(spark) - left)
            assert [p.rsplit("/", 1)[1] for p in files.parts(spark, path, "")] == ["sorted.bam", "sorted.bam.index"] and target.endswith("/sorted.bam")
        query(spark, "/root/testdata/sf0.001")
        seen.append(_shuffled(spark) - left)
    assert max(seen) < 10_000


def test_parts_go_as_they_are_copied(tmp_path, monkeypatch):
    """While parts are put together, no block is there twice; a commit that failed is still undone."""
    from types import SimpleNamespace

    from cellweave.sources import formats

    writer = formats.AlignmentWriter("bam", {"path": str(tmp_path / "x.bam"), "single": "true"}, True)
    system, folder = formats.located(writer.folder)
    system.create_dir(folder)
    parts = [SimpleNamespace(name=f"{folder}/part-{k}", part=k, entries=[[0, 1, []]]) for k in range(3)]
    for p in parts:
        with system.open_output_stream(p.name) as out:
            out.write(bytes(100_000))
    there = []

    class Watched:
        def __getattr__(self, name):
            return getattr(system, name)

        def open_input_file(self, name):
            there.append(len(list((tmp_path / folder.rsplit("/", 1)[1]).iterdir())))
            return system.open_input_file(name)

    monkeypatch.setattr(formats, "located", lambda path: (Watched(), path))
    writer.commit(parts)
    assert there == [3, 2, 1] and sorted(p.name for p in tmp_path.iterdir()) == ["x.bam", "x.bam.index"]
    writer.abort(parts)


def test_sam_in_blocks(spark, tmp_path):
    """The same rows as of plain files, also in splits, in less space; a file has its end, one without rows the header."""
    from cellweave.plans.files import HEADER, _full
    from cellweave.sources import formats, readers, sinks

    rows = _full(spark, "/root/testdata/sf0.001")
    for name, blocks in (("plain", False), ("packed", True)):
        sinks.alignments(rows.coalesce(1), str(tmp_path / name), HEADER, "sam", blocks=blocks)
    (plain,), (packed,) = ([*(tmp_path / n).glob("part-*")] for n in ("plain", "packed"))
    assert packed.name.endswith(".sam.gz") and packed.read_bytes().endswith(formats.BGZF_END) and packed.stat().st_size < plain.stat().st_size / 3
    read = lambda name, **more: [tuple(r) for r in readers.alignments(spark, str(tmp_path / name), "r", columns=["rec", "qname", "qual", "CB"], **more).orderBy("rec").collect()]
    assert len(read("plain")) == rows.count() and read("packed") == read("plain") == read("packed", split=50_000)
    sinks.alignments(rows.limit(0), str(tmp_path / "none"), HEADER, "sam", blocks=True)
    assert readers.alignments(spark, str(tmp_path / "none"), "r").isEmpty()


def test_scans_leave_no_shuffle_files(spark, monkeypatch):
    """While files are read nothing of their writing is there; tasks read narrow rows a part each."""
    from cellweave.plans import queries
    from cellweave.sources import readers

    before, seen = _shuffled(spark), []
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    alignments = readers.alignments
    monkeypatch.setattr(readers, "alignments", lambda spark, path, *more, **named: seen.append((_shuffled(spark) - before, [f for f in queries._local(spark, path)])) or alignments(spark, path, *more, **named))
    assert queries.scan_sam(spark, "/root/testdata/sf0.001").count() == 3
    assert seen[0][0] < 10_000 and all(f.endswith(".sam.gz") for f in seen[0][1])
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split
