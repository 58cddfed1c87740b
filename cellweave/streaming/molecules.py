"""Counts over a stream of reads: distinct molecules within a watermark, as rows or as increments of counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import removed, shared_folder, written_once


def distinct_molecules(stream: DataFrame, keys: list[str], time: str = "ts", lateness: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Rows of a stream, one for each distinct keys and time window; state is dropped with the watermark."""
    started = stream.withColumn("window_start", F.window(time, window)["start"])
    return started.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, "window_start"])


#: Parts that molecules are dealt out to by hash, each with its keys: a state a part, not one a key, so that many small keys cost a few calls, and those of a large cell are kept by several tasks.
PARTS = 512


def _counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, names: list[str]) -> Iterator[pd.DataFrame]:
    """State: keys and molecules of a part that are alive (a text of each), and until when (milliseconds of event time)."""
    alive = dict(zip(*state.get, strict=True)) if state.exists else {}
    seen = []
    for frame in frames:
        latest = frame.sort_values("until").drop_duplicates("known", keep="last")
        fresh = [k not in alive for k in latest["known"]]
        for k, t in zip(latest["known"], latest["until"], strict=True):
            alive[k] = max(int(t), alive.get(k, 0))
        seen.append(latest.loc[fresh, names])
    now = state.getCurrentWatermarkMs()
    alive = {m: t for m, t in alive.items() if t > now}
    if alive:
        state.update((list(alive), list(alive.values())))
        state.setTimeoutTimestamp(min(alive.values()))
    elif state.exists:
        state.remove()
    found = pd.concat(seen) if seen else None
    if found is not None and len(found):
        yield found.groupby(names, dropna=False, sort=False).size().rename("n").reset_index()


def molecule_increments(stream: DataFrame, keys: list[str], molecule: str, time: str = "ts", lateness: str = "1 hour", life: str = "1 hour", parts: int = PARTS) -> DataFrame:
    """The keys and n, how many molecules (column molecule, text) are new to them, for every part of a micro-batch that brings some: counts are sums of n.

    Molecules, with their keys, are dealt out to parts by hash: as many as keep a part's state, which a task holds whole, small.

    A molecule is known until the life after it was last seen has passed in event time; then its state goes, and it would be a new one.
    Rows behind the watermark are late: Spark drops them and says how many. So the state is that of the molecules of about
    lateness + life, whatever has gone by.
    """
    until = F.unix_millis(F.col(time) + F.expr(f"interval {life}")).alias("until")
    known = F.to_json(F.array(*[F.col(k).cast("string") for k in keys], F.col(molecule).cast("string"))).alias("known")
    rows = stream.withWatermark(time, lateness).select(*keys, known, time, until)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("known"), F.lit(parts)).cast("int"))
    fields = ", ".join(f"{n} {dict(stream.dtypes)[n]}" for n in keys)
    return rows.groupBy("part").applyInPandasWithState(partial(_counted, names=keys), f"{fields}, n long", "known array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: In how many pieces the table of a query comes in, in the order of time.
PIECES = 6


def arrived(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator makes of the events table that comes in as a stream, piece by piece in the order of time; written."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    first, last = events.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    width = ((last or 0) - (first or 0)) // PIECES + 1
    running = None
    try:
        for k in range(PIECES):
            begin = (first or 0) + k * width
            events.filter((F.unix_millis("ts") >= begin) & (F.unix_millis("ts") < begin + width)).write.mode("append").parquet(f"{folder}/in")
            if running is None:
                made = operator(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
                running = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
            running.processAllAvailable()
        return written_once(spark.read.schema(made.schema).parquet(f"{folder}/rows"))
    finally:
        if running is not None:
            running.stop()
        removed(spark, folder)


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, n: distinct windows over the events table, read as a stream to its end."""
    found = arrived(spark, sf_dir, lambda rows: distinct_molecules(rows, ["user_id", "event_type"]))
    return found.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def streamed_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, n: the same from increments of counts, whose state lives for the length of a window."""

    def increments(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("started", F.window("ts", "10 minutes")["start"].cast("string"))
        return molecule_increments(named, ["user_id", "event_type"], "started", life="10 minutes")

    return arrived(spark, sf_dir, increments).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))
