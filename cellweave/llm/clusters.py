"""Clustering of vectors around centroids, in integers, with block-norm screening.

Components become integers (floor of the scale times each). A vector is cut into segments; of each its compressed form keeps the sum
of its components and the norm of what is left when their mean is taken away. By Cauchy and Schwarz the squared distance of two
segments is at least (difference of sums)**2 / length + (difference of norms)**2, so the compressed forms of vectors, made once, and of
centroids, made each round, bound every distance from below. A vector's exact distance to the centroid of the least bound is
worked out first; of the other centroids only those whose bound isn't above it get an exact distance, in 64-bit integers. Bounds are
taken a little lower than they come out, so that rounding never rules a centroid out.

Each round is one pass over the vectors with sums by task and cluster, added up by Spark: the driver gets clusters x components
numbers. When a round leaves the centroids as they were, the rounds left would do so too and are left out.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out. Components that come
to more than 2**27 or less than -2**27 count as that, so that distances fit 64 bits (sums of distances that don't are null). With fewer vectors than centroids each vector
is a centroid at first. Vectors of one id begin in the order of their components; a null id is hashed like an empty one. Repeated rows
have a row each. An empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, scratch

LARGEST = 1 << 27


@dataclass(frozen=True)
class Plan:
    length: int = 64
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"
    segment: int = 8


def compressed(vectors: np.ndarray, segment: int) -> np.ndarray:
    """Of each segment the sum over the root of its length, and the norm of the rest: squared distances of these bound those of the vectors."""
    starts = np.arange(0, vectors.shape[1], segment)
    sizes = np.diff(np.append(starts, vectors.shape[1])).astype(np.float64)
    exact = vectors.astype(np.float64)
    sums = np.add.reduceat(exact, starts, axis=1)
    rest = np.maximum(np.add.reduceat(exact * exact, starts, axis=1) - sums * sums / sizes, 0.0)
    return np.hstack([sums / np.sqrt(sizes), np.sqrt(rest)])


def squared(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    apart = vectors.astype(np.int64) - to
    return np.einsum("ij,ij->i", apart, apart)


def nearest(vectors: np.ndarray, short: np.ndarray, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller one of ties) and squared distance of each vector; how many exact distances that took."""
    small = compressed(centroids, segment)
    apart = short[:, None, :] - small[None, :, :]
    below = np.einsum("ijk,ijk->ij", apart, apart)
    # rounding: a share of the squares that the bound is made of
    size = np.einsum("ij,ij->i", short, short)[:, None] + np.einsum("ij,ij->i", small, small)[None, :]
    below -= 1e-9 * size + 1
    first = below.argmin(axis=1)
    best, at = squared(vectors, centroids[first]), first.astype(np.int64)
    exact = len(vectors)
    for k in range(len(centroids)):
        open_ = np.flatnonzero((below[:, k] <= best) & (first != k))
        if len(open_):
            found = squared(vectors[open_], centroids[k])
            nearer = (found < best[open_]) | (found == best[open_]) & (k < at[open_])
            best[open_[nearer]], at[open_[nearer]] = found[nearer], k
            exact += len(open_)
    return at, best, exact


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _prepared(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = compressed(_matrix(batch.column(1), plan.length), plan.segment) if batch.num_rows else np.empty((0, 0))
        width = short.shape[1] if batch.num_rows else 1
        lists = pa.ListArray.from_arrays(np.arange(0, short.size + 1, width, dtype=np.int32), pa.array(short.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "vector", "short"])


#: Vectors that a task looks at together.
BLOCK = 4096


def _blocks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            short = part.column(2).flatten().to_numpy(zero_copy_only=False)
            yield part, _matrix(part.column(1), plan.length), short.reshape(part.num_rows, -1)


def _summed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, plan: Plan) -> Iterator[pa.RecordBatch]:
    """cluster, n, sums (by component): of this task."""
    k = len(centroids)
    sums, n = np.zeros((k, plan.length), np.int64), np.zeros(k, np.int64)
    for _, vectors, short in _blocks(batches, plan):
        at, _, _ = nearest(vectors, short, centroids, plan.segment)
        for j in np.unique(at):
            mine = vectors[at == j]
            sums[j] += mine.sum(axis=0, dtype=np.int64)
            n[j] += len(mine)
    full = np.flatnonzero(n)
    lists = pa.ListArray.from_arrays(np.arange(0, len(full) * plan.length + 1, plan.length, dtype=np.int32), pa.array(sums[full].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), lists], names=["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, plan: Plan) -> Iterator[pa.RecordBatch]:
    for part, vectors, short in _blocks(batches, plan):
        at, best, _ = nearest(vectors, short, centroids, plan.segment)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])


def whole_vectors(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """vec_id, vector (integers) of the rows vec_id, embedding that are clustered."""
    rows = pick(rows, "vec_id", "embedding")
    fine = (F.size("embedding") == plan.length) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = float(LARGEST // plan.scale)
    integer = lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double"))) * plan.scale).cast("int")
    return rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", integer).alias("vector"))


def clustered(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every vector of rows (vec_id, embedding)."""
    prepared = whole_vectors(rows, plan).mapInArrow(partial(_prepared, plan=plan), "vec_id long, vector array<int>, short array<double>")
    with scratch(prepared) as vectors:
        named = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        start = vectors.select("vector").orderBy(named, "vector").limit(plan.clusters).collect()  # as many as there are centroids
        centroids = np.array([r["vector"] for r in start], np.int64).reshape(len(start), plan.length)
        for _ in range(plan.rounds if len(centroids) else 0):
            parts = vectors.mapInArrow(partial(_summed, centroids=centroids, plan=plan), "cluster int, n long, sums array<long>")
            each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "x"))
            new = centroids.copy()
            # exact sums: a row for each cluster and component
            for r in each.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect():
                new[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
            if (new == centroids).all():
                break
            centroids = new
        done = cut(vectors.mapInArrow(partial(_assigned, centroids=centroids, plan=plan), "vec_id long, cluster int, distance long"))
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # a row a cluster
    fits = lambda x: x if x < 1 << 63 else None
    about = [(j, fits(totals.get(j, 0)), fits(sum(totals.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    report = done.sparkSession.createDataFrame(about, "its int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(report), done["cluster"] == report["its"]).drop("its")
