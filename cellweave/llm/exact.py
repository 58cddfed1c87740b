"""Exact dedup by content sort.

Rows are sorted by content over all tasks: sampled splitters deal ranges of (start of the text,
64-bit hash, doc_id) to tasks, so one text with a third of all rows spreads over many; in a task
an external sort by (start, hash, whole text, doc_id) places equal texts side by side, and each row's
whole text is compared with the one before. Runs of equal texts that reach the edge of a task are joined
with their other parts by the SHA-256 of the text: two runs a task at most.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null doc_id
ranks below all others; of fully equal rows one stays; an empty table gives an empty table; other
columns are ignored. The splitter sample holds 32 characters, a hash and an id per row, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

START = 32
WALKED = "doc_id long, sha string, run_keep long, run_size long, last boolean, edge boolean"


def unchanged(text: Column) -> Column:
    return text


def _rows(ids: pa.Array, shas: pa.Array, keep: list, size: list, last: list, edge: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, shas, pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(last, pa.bool_()), pa.array(edge, pa.bool_())],
        names=["doc_id", "sha", "run_keep", "run_size", "last", "edge"],
    )


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows doc_id, sha, text: each row with the largest id and the size of its run.

    The ids of the open run are held until it ends, its text once.
    """
    open_ids: list[pa.Array] = []
    open_sha = open_text = None
    first = True

    def close(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        n = len(ids)
        return _rows(ids, pa.array([open_sha] * n, pa.string()), [ids[n - 1].as_py()] * n, [n] * n, [False] * (n - 1) + [True], [edge] * n)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, shas, texts = (batch.column(i) for i in range(3))
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        starts = np.concatenate(([0], 1 + np.flatnonzero(~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)))) if n > 1 else np.array([0])
        ends = np.append(starts[1:], n)
        k = 0
        if open_ids and texts[0].as_py() == open_text:
            open_ids.append(ids.slice(0, ends[0]))
            k = 1
        if k == len(starts):
            continue
        if open_ids:
            yield close(first)
            first = False
        # whole runs of this batch: all but the last, which may go on
        a, b = starts[k], starts[-1]
        if b > a:
            sizes = (ends - starts)[k:-1]
            lasts = (ends - 1)[k:-1]
            keep = np.repeat(lasts, sizes)
            edge = np.zeros(b - a, bool)
            if first:
                edge[: sizes[0]] = True
                first = False
            is_last = np.zeros(b - a, bool)
            is_last[lasts - a] = True
            yield _rows(ids.slice(a, b - a), shas.slice(a, b - a), ids.take(pa.array(keep)), np.repeat(sizes, sizes), is_last, edge)
        open_ids, open_sha, open_text = [ids.slice(b)], shas[n - 1].as_py(), texts[n - 1].as_py()
    if open_ids:
        yield close(True)


def content_runs(docs: DataFrame, normalise=unchanged) -> DataFrame:
    """doc_id, sha, keep_id, group_size, kept for every row; normalise: text column to text column."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select(F.substring("text", 1, START).alias("start"), F.xxhash64("text").alias("h"), "doc_id", "text")
    dealt = rows.repartitionByRange("start", "h", "doc_id").sortWithinPartitions("start", "h", "text", "doc_id")
    runs = cut(dealt.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "text").mapInArrow(walk, WALKED))
    edges = runs.filter("edge and last").groupBy(F.col("sha").alias("whole")).agg(F.max("run_keep").alias("keep"), F.sum("run_size").alias("size"))
    # two rows a task of the sort at most, about 100 bytes each
    joined = runs.join(F.broadcast(edges), runs["edge"] & (runs["sha"] == edges["whole"]), "left")
    keep = F.when(F.col("whole").isNull(), F.col("run_keep")).otherwise(F.col("keep"))
    return joined.select("doc_id", "sha", keep.alias("keep_id"), F.coalesce("size", "run_size").alias("group_size"), (F.col("last") & F.col("run_keep").eqNullSafe(keep)).alias("kept"))
