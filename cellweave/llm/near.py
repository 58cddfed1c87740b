"""N-gram Jaccard join by rare-first prefix filtering.

A text is the set of its distinct word shingles; two texts link when 100 * intersection >= percent
* union. The shingles of a set are put in one global order, rare ones first; linked sets share a shingle of their
prefixes of n - ceil(t n) + 1. How rare a shingle is, is read from a table of counts by hash: it
covers all rows, and its 2**22 cells are a fixed size; a crowded table only makes prefixes less rare.

1. Texts with equal sets are one node.
2. Prefixes are dealt out by shingle. Of each shingle's holders one is the hub, the one where the shingle
   stands first. Holders that pass the length and positional filters are paired with it. The holders of a shingle that the table
   says is hot are dealt out in groups by hash, each with a hub of its own; these are paired with the first of them, the shingle's hub.
3. Pairs whose sketches rule out a link go: a sketch has the number of a set's shingles in each range of the hash, some 4 to 8, and the
   lesser numbers bound what two sets share (a suffix filter without the sets). The others are verified once, on the whole sets
   (made again for the texts of the nodes in pairs), after a suffix filter of finer ranges.
4. Nodes linked so far are joined to components. Then holders outside the hub's
   component are paired with the other holders in other components, by the same filters, and
   verified. Pairs in one component are not needed: no result depends on them.
5. The components of all links give each text the smallest doc_id it reaches.

So a group of copies costs a few pairs a member, and no link between components is lost.

Defined cases: null, empty and blank texts have empty sets and link with nothing; texts of fewer words than a
shingle have one shingle of all; rows are texts, repeated or not; null doc_ids are passed over by the smallest doc_id (null if
there is no other); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, packed, pick, scratch, text_key, unpacked
from .components import components, joined_components
from .shingles import shingle_sets

CELL_BITS, BLOCK_BITS = 22, 16
#: Bits of the filter that tells workers which texts have partners: 8 a text, within these bounds.
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 29
#: The two numbers that a filter makes of a key.
SHIFTS = (0, 29)


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    percent: int = 80

    def least_common(self, n: int) -> int:
        """Least intersection of a set of n with a linked one."""
        return -(-self.percent * n // 100)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(column)
            yield batch, texts.fill_null("") if texts.null_count else texts


def _count_cells(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Counts of this task by block of cells: places and counts, or all counts."""
    cells = np.zeros(1 << CELL_BITS, np.uint32)
    waiting: list[np.ndarray] = []
    held = 0

    def add() -> None:
        if waiting:
            np.add(cells, np.bincount(np.concatenate(waiting), minlength=len(cells)).astype(np.uint32), out=cells)
            waiting.clear()

    for _, texts in _texts(batches, 0):
        for found in shingle_sets(texts, words):
            waiting.append((found & np.uint64(len(cells) - 1)).astype(np.int32))
            held += len(found)
            if held > 1_000_000:
                add()
                held = 0
    add()
    blocks, places, counts = [], [], []
    for k, block in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
        full = np.flatnonzero(block)
        if len(full):
            kind = np.uint8 if block.max() < 256 else np.uint16 if block.max() < 65536 else np.uint32
            dense = len(full) * (2 + np.dtype(kind).itemsize) > len(block) * np.dtype(kind).itemsize
            blocks.append(k)
            places.append(b"" if dense else full.astype(np.uint16).tobytes())
            counts.append((block if dense else block[full]).astype(kind).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["block", "places", "counts"])


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks summed, as 8 steps per doubling of the count."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(places) // 2 or 1 << BLOCK_BITS
            values = np.frombuffer(counts, f"u{len(counts) // n}")
            into = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, np.int64))
            if places:
                into[np.frombuffer(places, np.uint16)] += values
            else:
                into += values
    steps = [np.minimum(255, np.round(8 * np.log2(1 + v))).astype(np.uint8).tobytes() for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], names=["block", "steps"])


def rarity(rows: DataFrame, like: Likeness) -> np.ndarray:
    """The table of counts of all rows' shingles: 4 MB, whatever the input."""
    parts = rows.select("text").mapInArrow(partial(_count_cells, words=like.words), "block int, places binary, counts binary")
    blocks = 1 << CELL_BITS - BLOCK_BITS
    table = np.zeros((blocks, 1 << BLOCK_BITS), np.uint8)
    tasks = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for row in parts.repartition(tasks, "block").mapInArrow(_sum_cells, "block int, steps binary").collect():
        table[row["block"]] = np.frombuffer(row["steps"], np.uint8)
    return table.reshape(-1)


def node_of(found: np.ndarray, salt: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    return tuple(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest(), np.int64).tolist())


#: Holders that a group of a hot shingle has, about.
GROUP = 256


def group_counts(cells: np.ndarray) -> np.ndarray:
    """In how many groups a shingle's holders are dealt, by the step of its cell: 0 (not at all) unless the cell is full and far above the mean."""
    counts = 2 ** (np.arange(256) / 8) - 1
    mean = float((np.bincount(cells, minlength=256) * counts).sum() / len(cells))
    return np.where(counts > max(GROUP, 8 * mean), np.minimum(np.ceil(counts / GROUP), 1 << 30), 0).astype(np.int64)


PREFIXES = "doc_id long, key long, n long, node long, twin long, prefix array<long>, groups array<int>, sketch binary"


def sketch_of(found: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of 2**k even ranges of the hash, one byte each; 255 stands for that and more."""
    bits = max(0, (len(found) - 1).bit_length() - 3)
    ranges = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
    return np.minimum(np.bincount(ranges, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def within_reach(x: bytes, y: bytes, percent: int) -> bool:
    """Whether sets with these sketches can link."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if max(x.max(), y.max()) == 255:
        return True
    n = min(len(x), len(y))
    x, y = (v.reshape(n, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum()) * (100 + percent) >= percent * int(x.sum() + y.sum())


def _reachable(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield batch.select([0, 1]).filter(pa.array([within_reach(x, y, percent) for x, y in sketches], pa.bool_()))


def _prefixes(batches: Iterator[pa.RecordBatch], like: Likeness, table, salt: int) -> Iterator[pa.RecordBatch]:
    cells = table.value
    mask = np.uint64(len(cells) - 1)
    counts = group_counts(cells)
    for batch, texts in _texts(batches, 1):
        sizes, nodes, twins, prefixes, groups, sketches = [], [], [], [], [], []
        for found in shingle_sets(texts, like.words):
            n = len(found)
            node, twin = node_of(found, salt) if n else (None, None)
            keep = n - like.least_common(n) + 1 if n else 0
            step = cells[(found & mask).astype(np.int64)]
            # found is sorted, so a stable sort by step orders by (step, hash)
            first = np.argsort(step, kind="stable")[:keep]
            prefixes.append(found[first].view(np.int64))
            dealt = counts[step[first]]
            # the number of a node's group, from 1; null if no shingle of the prefix is hot
            groups.append((np.where(dealt > 0, (node or 0) % np.maximum(dealt, 1) + 1, 0)).tolist() if dealt.any() else None)
            sizes.append(n)
            nodes.append(node)
            twins.append(twin)
            sketches.append(sketch_of(found) if n else None)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), lists, pa.array(groups, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], names=[x.split()[0] for x in PREFIXES.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch], like: Likeness, wanted, salt: int) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose key the filter knows."""
    bits = np.frombuffer(wanted.value, np.uint8)
    mask = len(bits) * 8 - 1
    for batch, texts in _texts(batches, 1):
        keys = batch.column(0).to_numpy()
        known = np.ones(len(keys), bool)
        for shift in SHIFTS:
            at = (keys >> shift) & mask
            known &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        nodes, sets = [], []
        for found in shingle_sets(texts.filter(pa.array(known)), like.words):
            if len(found):
                nodes.append(node_of(found, salt)[0])
                sets.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])


def _mark(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Filter bits of this task's keys, by block of 64 KB."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        for shift in SHIFTS:
            at = (nodes >> shift) & (size - 1)
            for k in np.unique(at >> 19):
                mine = at[at >> 19 == k] & (1 << 19) - 1
                np.bitwise_or.at(blocks.setdefault(int(k), np.zeros(1 << 16, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A filter that holds all keys and few others: of 64 MB at most."""
    size = LEAST_FILTER * 8
    n = keys.count()
    while size < min(8 * n, MOST_FILTER):
        size *= 2
    bits = np.zeros(size // 8, np.uint8)
    parts = keys.repartition(max(1, min(64, size >> 22)), "key").mapInArrow(partial(_mark, size=size), "block int, bits binary")
    for row in parts.toLocalIterator():
        bits[row["block"] << 16 : (row["block"] + 1) << 16] |= np.frombuffer(row["bits"], np.uint8)
    return bits


def _common(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Size of the intersection of two sorted sets, or less than least if it can't reach it.

    The suffix filter: hashes are even, so sets are cut into ranges of the hash, and the smaller count
    of each range bounds what they share there.
    """
    if len(x) + len(y) > 64:
        n = max(8, min(len(x), len(y)) // 8)
        ranges = np.arange(1, n, dtype=np.uint64) * np.uint64((1 << 64) // n)
        a, b = (np.diff(np.concatenate(([0], np.searchsorted(v, ranges), [len(v)]))) for v in (x, y))
        if np.minimum(a, b).sum() < least:
            return 0
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y)
            if 100 * (c := _common(x, y, -(-percent * both // (100 + percent)))) >= percent * (both - c):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def near_enough(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Length and positional filters for a shared shingle at places pos and at of sets of n and m."""
    rest = F.least(n - pos, m - at)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent)


def linked(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, node (name of the set), root (name of the component), component_id for every row."""
    named = _rooted(docs, like)[0]
    # cut: a join of two plain shuffles, which adaptive execution splits where a component is large
    least = cut(named.filter("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least")))
    full = named.join(least, named["root"] == least["of"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return full.select("doc_id", "n_shingles", "node", "root", component.alias("component_id"))


def _rooted(docs: DataFrame, like: Likeness) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, node, root for every row, written; and the salt of the names."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    table = spark.sparkContext.broadcast(rarity(rows, like))
    salt = 0
    while True:
        with contextlib.ExitStack() as later:
            # the prefixes of all rows are of use until one of each set is picked, those until they are dealt out
            with scratch(rows.select("doc_id", "text", "key").mapInArrow(partial(_prefixes, like=like, table=table, salt=salt), PREFIXES)) as found:
                full = found.filter("n > 0")
                names = full.groupBy("node").agg(F.min("twin").alias("x"), F.max("twin").alias("y"))
                if not names.filter("x <> y").isEmpty():
                    salt += 1  # two sets of one name: name them anew
                    continue
                named = cut(found.select("doc_id", F.col("n").alias("n_shingles"), "node", "key"))
                nodes = later.enter_context(scratch(full.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "groups", "sketch")])))
            holders = _holders(nodes, like)
            sketches = cut(nodes.select("node", "sketch"))
            break
    keys = named.filter("node is not null").select(F.col("node").alias("its"), "key").distinct()  # copies are one
    roots = _roots(rows, holders, sketches, keys, like, salt)
    named = named.drop("key").join(roots.withColumnRenamed("node", "its"), named["node"] == F.col("its"), "left").withColumn("root", F.coalesce("root", "node")).drop("its")
    return cut(named), salt


def _holders(nodes: DataFrame, like: Likeness) -> DataFrame:
    """token, part, node, n, pos of prefixes, the hub of the token's part; many: it has three holders or more; paired: a candidate with the hub."""
    holders = nodes.select("node", F.col("n").cast("int").alias("n"), "groups", F.posexplode("prefix").alias("pos", "token"))
    holders = holders.withColumn("part", F.coalesce(F.get("groups", "pos"), F.lit(0)))
    by_token = Window.partitionBy("token", "part")
    ranked = by_token.orderBy("pos", F.xxhash64("node"), "node")
    me = F.struct("node", "n", "pos")
    near = {i: F.lag("node", -i).over(ranked).isNotNull() for i in (-2, -1, 1, 2)}
    several = near[2] | near[-2] | near[1] & near[-1] | (F.col("part") > 0)
    holders = holders.select("token", "part", "node", "n", "pos", F.first(me).over(ranked).alias("hub"), several.alias("many"))
    close = near_enough(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), like.percent)
    # of two holders, the pair with the hub is the only one: rows of three and more are needed again
    holders = holders.withColumn("paired", (F.col("node") != F.col("hub.node")) & close).filter("many or paired")
    return cut(holders.select("token", "part", "node", "n", "pos", F.col("hub.node").alias("hub"), "many", "paired"))


def _within_reach(pairs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """The pairs a, b whose sketches allow a link, written."""
    left = sketches.select(F.col("node").alias("x"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("node").alias("y"), F.col("sketch").alias("right"))
    both = pairs.join(left, pairs["a"] == left["x"]).join(right, pairs["b"] == right["y"]).select("a", "b", "left", "right")
    return cut(both.mapInArrow(partial(_reachable, percent=like.percent), "a long, b long"))


def _roots(rows: DataFrame, holders: DataFrame, sketches: DataFrame, keys: DataFrame, like: Likeness, salt: int) -> DataFrame:
    """node, root of the nodes that have links."""
    # the hubs of a hot token's parts, and the first of them
    hubs = holders.filter("part > 0 and node = hub").select("token", "node", "n", "pos")
    tops = hubs.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("node").alias("h"), "node", "n")).alias("top"))
    tops = cut(tops.select(F.col("token").alias("its_token"), "top"))
    close = near_enough(F.col("n"), F.col("pos"), F.col("top.n"), F.col("top.pos"), like.percent)
    between = hubs.join(tops, hubs["token"] == tops["its_token"]).filter((F.col("node") != F.col("top.node")) & close).select("node", F.col("top.node").alias("hub"))
    pairs = holders.filter("paired").select("node", "hub")
    hot = not tops.isEmpty()
    if hot:
        pairs = pairs.unionByName(between)
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = _verified(_within_reach(pairs, sketches, like), rows, keys, like, salt)
    roots = cut(components(first))

    def component(df: DataFrame, node: str, name: str) -> DataFrame:
        its = roots.select(F.col("node").alias("its"), F.col("root").alias(name))
        return df.join(its, df[node] == its["its"], "left").withColumn(name, F.coalesce(name, node)).drop("its")

    many = holders.filter("many").select("token", "node", "n", "pos", "hub")
    if hot:
        many = many.join(tops, many["token"] == tops["its_token"], "left").withColumn("hub", F.coalesce("top.node", "hub")).drop("its_token", "top")
    known = cut(component(component(many, "node", "root"), "hub", "hub_root"))
    apart = known.filter("root <> hub_root").select("token", "node", "n", "pos", "root", "hub", "hub_root")
    # a join of two plain shuffles, which adaptive execution splits where a token has many holders
    others = known.select(F.col("token").alias("its"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other_root"))
    new = (F.col("root") != F.col("other_root")) & (F.col("other") != F.col("hub")) & ((F.col("other_root") == F.col("hub_root")) | (F.col("node") < F.col("other")))
    more = apart.join(others, (apart["token"] == others["its"]) & new & near_enough(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), like.percent))
    pairs = more.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = _within_reach(pairs, sketches, like)
    return roots if pairs.isEmpty() else joined_components(roots, _verified(pairs, rows, keys, like, salt))


def _verified(pairs: DataFrame, rows: DataFrame, keys: DataFrame, like: Likeness, salt: int) -> DataFrame:
    """The pairs a, b that link. Sets are made again, of one text of each node in pairs (keys: its, the node; key of the text)."""
    context = rows.sparkSession.sparkContext
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = context.broadcast(key_filter(cut(nodes.join(keys, nodes["node"] == keys["its"]).select("key").distinct())).tobytes())
    sets = rows.select("key", "text").mapInArrow(partial(_sets, like=like, wanted=wanted, salt=salt), "node long, tokens binary")
    with scratch(sets.groupBy("node").agg(F.first("tokens").alias("tokens"))) as sets:
        left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("left"))
        right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("right"))
        both = pairs.join(left, pairs["a"] == left["x"]).join(right, pairs["b"] == right["y"]).select("a", "b", "left", "right")
        return cut(both.mapInArrow(partial(_verify, percent=like.percent), "a long, b long"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The documents, of each component only the row with the smallest doc_id (none ranks last), with all their columns.

    Of rows of one doc_id the one with the smallest name of its set stays; rows equal in both are numbered, among
    themselves only, and one of them stays.
    """
    found, salt = _rooted(docs, like)
    found = found.filter("node is not null")
    twins = cut(found.groupBy("root", "doc_id", "node").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")))
    best = cut(twins.groupBy(F.col("root").alias("of")).agg(F.min("rank").alias("best")))
    ranked = twins.join(best, twins["root"] == best["of"]).select("doc_id", "node", "n", (F.col("rank") != F.col("best")).alias("all"))
    goes = cut(ranked.filter("all or n > 1").select(F.col("doc_id").alias("its_id"), F.col("node").alias("its_node"), "all"))
    if goes.count() <= BROADCAST_ROWS:
        goes = F.broadcast(goes)
    named = packed(docs, "doc_id", "text").withColumn("node", _node_column(F.coalesce(F.col("text").cast("string"), F.lit("")), like, salt))
    both = named.join(goes, F.col("doc_id").cast("long").eqNullSafe(F.col("its_id")) & (F.col("node") == F.col("its_node")), "left")
    kept = unpacked(both.filter("its_node is null"), docs.columns)
    if goes.filter("not all").isEmpty():
        return kept
    order = Window.partitionBy("doc_id", "node").orderBy(F.lit(1))
    ties = both.filter("not all").withColumn("k", F.row_number().over(order)).filter("k = 1")
    return kept.unionByName(unpacked(ties, docs.columns))


def _node_column(text: Column, like: Likeness, salt: int) -> Column:
    """Name of a text's set, null for an empty one."""

    @F.pandas_udf("long")
    def name(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        sets = shingle_sets(pa.array(texts, pa.large_string()), like.words)
        return pd.Series([node_of(s, salt)[0] if len(s) else None for s in sets], dtype="Int64")

    return name(text)
