from datetime import datetime, timedelta

from cellweave.streaming import molecules
from cellweave.streaming.molecules import distinct_molecules


def test_molecules_once_per_window(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=m), "c", u) for m, u in ((0, "a"), (1, "a"), (2, "b"), (11, "a"))]
    spark.createDataFrame(rows, "ts timestamp, CB string, UB string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, CB string, UB string").parquet(str(tmp_path / "in"))
    running = distinct_molecules(stream, ["CB", "UB"]).writeStream.format("memory").queryName("molecules").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted((r.UB, r.window_start.minute) for r in spark.table("molecules").collect()) == [("a", 0), ("a", 10), ("b", 0)]


def test_query_goes_through_the_operator_and_not_through_the_driver(spark, tmp_path, monkeypatch):
    """Rows in any order over days are counted by the operator; nothing is gathered in a memory table."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=37 * ((i * 61) % 200)), i % 3, "k") for i in range(200)] * 2
    frame = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string")
    frame.write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "events.parquet"))
    calls = []
    monkeypatch.setattr(molecules, "distinct_molecules", lambda *a, **b: calls.append(a) or distinct_molecules(*a, **b))
    got = {r.user_id: r.n for r in molecules.streamed_counts(spark, str(tmp_path)).collect()}
    assert got == {u: len({(t - start) // timedelta(minutes=10) for t, v, _ in rows if v == u}) for u in range(3)}
    assert len(calls) == 1 and not any(t.name.startswith("streamed_") for t in spark.catalog.listTables())


def test_increments_with_late_rows_and_dropped_state(spark, tmp_path):
    """Counts grow as molecules come; a row behind the watermark is dropped; state of what is over goes."""
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, CB string, UB string"
    batches = [
        [(0, "c", "a"), (1, "c", "a"), (2, "c", "b"), (2, "d", "a")],
        [(30, "c", "a"), (31, "c", "x")],  # a is known still: life is an hour
        [(300, "c", "y")],
        [(301, "c", "a"), (10, "c", "late"), (302, "d", "a")],  # a has been forgotten, 10 is late
        [(900, "e", "z")],
        [(901, "e", "z")],
    ]
    (tmp_path / "in").mkdir()
    made = molecules.molecule_increments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["CB"], "UB", lateness="20 minutes", life="60 minutes", parts=4)
    running = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    late, kept = 0, []
    for rows in batches:
        spark.createDataFrame([(start + timedelta(minutes=m), c, u) for m, c, u in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        seen = len(running.recentProgress)
        running.processAllAvailable()
        for p in running.recentProgress[seen:]:
            late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        kept.append(running.lastProgress.stateOperators[0].numRowsTotal)
    running.stop()
    got = {r.CB: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("CB").sum("n").toDF("CB", "n").collect()}
    assert got == {"c": 2 + 1 + 1 + 1, "d": 2, "e": 1}
    assert late == 1 and kept[-1] <= 2 and max(kept) <= 8
