"""Molecules and fragments of alignments that are sorted by their tags, counted without a shuffle of reads.

Equal tags stand together in sorted files, so a task counts the molecules of its split where they are. Only a molecule at an edge of a split can go on
in another one: its fragments are handed on as rows, put together by Spark and counted then.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written_once
from .grouping import SortError

TAGS = ("CB", "UB", "GE")
COUNTS = ("reads", "molecules", "fragments", "single_fragments", "single_molecules")
#: kind: 0 counts of a cell and gene, 1 a fragment of an open molecule (reads: how many), 2 the first and the last row of a split.
FOUND = "kind int, part int, CB string, UB string, GE string, reference string, pos int, reverse boolean, mapped boolean, reads long, molecules long, fragments long, single_fragments long, single_molecules long"
KINDS = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
#: Fragments of one molecule, and pairs of cell and gene, that a task holds at most.
HELD = 100_000


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """A number for each value (0 for null), and the values by number."""
    found = column.dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, [None, *found.dictionary.to_pylist()]


def _sort_key(key: tuple, order: Sequence[str]) -> tuple:
    """A missing tag sorts as the empty text; texts by their bytes."""
    return tuple((key[TAGS.index(t)] or "").encode() for t in order)


class Counter:
    """What a task has found: the molecule that is open at the end, and counts by cell and gene."""

    def __init__(self, part: int, order: Sequence[str]):
        self.part, self.order = part, order
        self.key: tuple | None = None
        self.fragments: dict[tuple, int] = {}
        self.at_edge = True  # the first molecule of a split may have begun in the one before
        self.totals: dict[tuple, list[int]] = {}
        self.ready: list[tuple] = []

    def counted(self, pair: tuple, numbers: Sequence[int]) -> None:
        held = self.totals.setdefault(pair, [0] * 5)
        for i, x in enumerate(numbers):
            held[i] += int(x)
        if len(self.totals) > HELD:
            self.hand_on_totals()

    def hand_on_totals(self) -> None:
        self.ready += [(0, self.part, cell, None, gene, None, None, None, None, *n) for (cell, gene), n in self.totals.items()]
        self.totals.clear()

    def hand_on_open(self) -> None:
        self.ready += [(1, self.part, *self.key, *f, n, None, None, None, None) for f, n in self.fragments.items()]
        self.fragments.clear()

    def close(self) -> None:
        """The open molecule is over."""
        if self.at_edge:
            self.hand_on_open()
        else:
            reads = sum(self.fragments.values())
            mapped = [n for f, n in self.fragments.items() if f[3]]
            self.counted((self.key[0], self.key[2]), (reads, 1, len(mapped), mapped.count(1), reads == 1))
        self.fragments, self.at_edge = {}, False

    def add(self, key: tuple, fragments: list[tuple[tuple, int]]) -> None:
        """Some fragments of a molecule, which stays open."""
        if self.key != key:
            if self.key is not None:
                self.close()
                self.check(self.key, key)
            self.key = key
        for f, n in fragments:
            self.fragments[f] = self.fragments.get(f, 0) + n
        if len(self.fragments) > HELD:
            self.hand_on_open()
            self.at_edge = True

    def check(self, before: tuple, after: tuple) -> None:
        if _sort_key(after, self.order) < _sort_key(before, self.order):
            raise SortError(f"{after} comes after {before}: not sorted by {list(self.order)}")


def _counted(batches: Iterator[pa.RecordBatch], order: Sequence[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    found = Counter(TaskContext.get().partitionId(), order)
    edge = lambda key: (2, found.part, *key, None, None, None, None, None, None, None, None, None)
    for b in batches:
        if not b.num_rows:
            continue
        (cells, cell_names), (molecules, molecule_names), (genes, gene_names), (places, place_names) = (_codes(b.column(i)) for i in range(4))
        pos, reverse, mapped = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5, 6))
        new = np.ones(len(cells), bool)
        new[1:] = (cells[1:] != cells[:-1]) | (molecules[1:] != molecules[:-1]) | (genes[1:] != genes[:-1])
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        each, n = np.unique(np.stack([of, places, pos, reverse, mapped], axis=1), axis=0, return_counts=True)
        ends = np.searchsorted(each[:, 0], np.arange(len(starts) + 1))
        key = lambda k: (cell_names[cells[starts[k]]], molecule_names[molecules[starts[k]]], gene_names[genes[starts[k]]])  # noqa: E731, B023

        def listed(k: int) -> list[tuple[tuple, int]]:
            return [((place_names[p], x, bool(r), bool(m)), c) for (_, p, x, r, m), c in zip(each[ends[k] : ends[k + 1]].tolist(), n[ends[k] : ends[k + 1]].tolist(), strict=True)]  # noqa: B023

        if found.key is None:
            yield _rows([edge(key(0))])
        last = len(starts) - 1
        found.add(key(0), listed(0))
        if last:
            for k in range(1, last + 1):
                found.check(key(k - 1), key(k))
            if last > 1:
                found.close()
                # molecules that begin and end in the batch, by cell and gene
                inner = slice(1, last)
                reads = np.diff(np.append(starts, len(cells)))[inner]
                seen = each[:, 4] == 1
                fragments = np.bincount(each[seen, 0], minlength=last + 1)[inner]
                single = np.bincount(each[seen & (n == 1), 0], minlength=last + 1)[inner]
                pair = cells[starts[inner]] * len(gene_names) + genes[starts[inner]]
                pairs, at = np.unique(pair, return_inverse=True)
                sums = np.zeros((len(pairs), 5), np.int64)
                np.add.at(sums, at, np.stack([reads, np.ones_like(reads), fragments, single, reads == 1], axis=1).astype(np.int64))
                for p, numbers in zip(pairs.tolist(), sums, strict=True):
                    found.counted((cell_names[p // len(gene_names)], gene_names[p % len(gene_names)]), numbers)
                found.key = None
            found.add(key(last), listed(last))
        if found.ready:
            yield _rows(found.ready)
            found.ready = []
    if found.key is not None:
        found.hand_on_open()
        found.hand_on_totals()
        yield _rows([*found.ready, edge(found.key)])


def sorted_pairs(features: DataFrame, order: Sequence[str] = TAGS) -> DataFrame:
    """One row per (cell, gene), as metrics.pairs has them, of features (read_features) whose rows are sorted by these tags over their partitions in order.

    The order is checked, within splits and from each to the next: SortError, or an error of the job. The driver sees two rows a split.
    """
    if sorted(order) != sorted(TAGS):
        raise ValueError(f"the order is one of {TAGS}")
    rows = features.select(*TAGS, "reference", F.col("pos").cast("int").alias("pos"), "reverse", "mapped")
    found = written_once(rows.mapInArrow(partial(_counted, order=tuple(order)), FOUND))
    edges: dict[int, list[tuple]] = {}
    for r in found.filter("kind = 2").select("part", *TAGS).collect():
        edges.setdefault(r["part"], []).append(_sort_key((r["CB"], r["UB"], r["GE"]), order))
    last = None
    for part in sorted(edges):
        if last is not None and min(edges[part]) < last:
            raise SortError(f"the files aren't sorted by {list(order)} from one split to the next")
        last = max(edges[part])
    fragments = found.filter("kind = 1").groupBy(*TAGS, "reference", "pos", "reverse", "mapped").agg(F.sum("reads").alias("n"))
    molecules = fragments.groupBy(*TAGS).agg(F.sum("n").alias("reads"), F.count_if("mapped").alias("fragments"), F.count_if(F.col("mapped") & (F.col("n") == 1)).alias("single_fragments"))
    opened = molecules.select("CB", "GE", "reads", F.lit(1).cast("long").alias("molecules"), "fragments", "single_fragments", (F.col("reads") == 1).cast("long").alias("single_molecules"))
    closed = found.filter("kind = 0").select("CB", "GE", *COUNTS)
    return closed.unionByName(opened).groupBy("CB", "GE").agg(*[F.sum(c).alias(c) for c in COUNTS])
