"""Main text of pages by differencing each page against its nearest by URL.

Pages are blocks of text (lines). Within a host they are ordered by URL path; each page is paired with the
neighbour that shares more of the path (the one before on a tie). Neighbours with the same open lines are copies and passed over:
the next page with other lines on either side is the neighbour. The two pages'
lines are aligned by a longest common subsequence, and the lines they share are deleted.

Every page is differenced. Plain differencing would also delete what two articles share (quoted passages, licence lines, copies of a
text), so a check by marks follows: lines inside a declared article - or main, or content element - stay though they are shared, and where a page
declares one, the lines outside it go though they aren't. A page without one is held against what its neighbours have outside
of theirs, since an article isn't a template; a page with one against all lines of its neighbours. n_shared tells how many lines of each page its neighbour has. The order over all pages is a range sort by (host, path), so a large host
spreads over many tasks; a task gets from the others only the pages next to its range, and the next with other lines than these.

Defined cases: null and empty html gives an empty text; a null url is a host of its own; repeated rows are rows of their
own and no partners of each other; pages alone on their host lose nothing to differencing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .htmltext import blocks


def row_name(page_id: int | None, url: str | None, html: str | None) -> bytes:
    return hashlib.blake2b(repr((page_id, url, html)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return "", url or ""
    return (parts.hostname or "").lower(), parts.path or "/"


def line_code(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of each prefix of b the length of a longest common subsequence with a: a bit a line of b, all bits at once (Hyyrö)."""
    masks: dict[int, bytearray] = {}
    for j, x in enumerate(b):
        masks.setdefault(x, bytearray(len(b) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    bits = {x: int.from_bytes(m, "little") for x, m in masks.items()}
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        if u := v & bits.get(x, 0):
            v = (v + u | v - u) & every
    left = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - left.astype(np.int64))])


def _by_bits(a: list[int], b: list[int]) -> list[int]:
    """common_lines in halves of a (Hirschberg), for lines that come again and again."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(a) // 2
    at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return _by_bits(a[:half], b[:at]) + [half + i for i in _by_bits(a[half:], b[at:])]


#: Pairs of equal lines, for each line of two pages, above which these are compared bit by bit.
MANY_PAIRS = 32


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b: by pairs of equal lines (Hunt and Szymanski), or where these are many by bits."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if sum(len(where.get(x, ())) for x in a) > MANY_PAIRS * (len(a) + len(b)):
        known = set(a)
        kept = [i for i, x in enumerate(a) if x in where]
        return [kept[i] for i in _by_bits([a[i] for i in kept], [x for x in b if x in known])]
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def nearness(a: str, b: str) -> int:
    """Characters that two paths share from the start."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


LIGHT = "name binary, host string, path string, page_id long, open boolean, lines array<long>"
NAMES = [x.split()[0] for x in LIGHT.split(", ")]
#: open: no article is declared; texts: all lines; held: whether each is of the article; lines, outer: codes of all, and of those outside of any article.
PARSED = "page_id long, url string, name binary, host string, path string, open boolean, texts array<string>, held array<boolean>, lines array<long>, outer array<long>"
LIGHT_KINDS = [pa.binary(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]


Light = tuple  # name, host, path, page_id, open, lines; then the task, or the place that a page was handed on to


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Light]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def alike(a: Light | None, b: Light | None) -> bool:
    """Same host and lines: copies, for differencing."""
    return bool(a and b) and (a[1], a[5]) == (b[1], b[5])


EDGES = f"task int, slot int, {LIGHT}, same binary"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first page, the first unlike it, the last unlike the last, the last; the two between only if there are any. same: what alike() compares."""
    first = unlike_first = unlike_last = last = None
    for row in _rows(batches):
        first = first or row
        if not unlike_first and not alike(first, row):
            unlike_first = row
        if last and not alike(last, row):
            unlike_last = last
        last = row
    if first:
        task = first[6]
        rows = [first, unlike_first, unlike_last, last] if unlike_first else [first, last]
        columns = [[task] * len(rows), range(len(rows)), *list(zip(*rows, strict=True))[:6], [hashlib.blake2b(repr((r[1], r[5])).encode(), digest_size=16).digest() for r in rows]]
        kinds = [pa.int32(), pa.int32(), *LIGHT_KINDS, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EDGES.split(", ")])


Edge = tuple  # task, slot, same


def carried(found: list[list[Edge]]) -> list[list[Edge]]:
    """Of each task, in order: what the tasks before it end with - the last page unlike the last, and the last."""
    out, state = [], []
    for rows in found:
        out.append(state)
        if len(rows) == 4:
            state = rows[2:]
        else:  # pages that are all alike
            state = [*(state[:-1] if state and state[-1][2] == rows[-1][2] else state[-1:]), rows[-1]]
    return out


def deleted(row: Light, before: Light | None, after: Light | None) -> list[int]:
    """Numbers of the row's lines that it shares with the nearer neighbour on its host."""
    near = [x for x in (before, after) if x and x[1] == row[1] and x[5] != row[5]]
    if not near or not row[5]:
        return []
    best = max(near, key=lambda x: nearness(x[2], row[2]))  # the first of equals: the one before
    return common_lines(row[5], best[5])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, stays (whether each line does): for pages marked open. place is 0 for a task's own pages, else the page is handed on from another."""
    names: list[bytes] = []
    stays: list[list[bool]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(stays, pa.list_(pa.bool_()))], names=["name", "stays"])

    last = now = None  # the page before the copies at hand, the latest of these
    waiting: list[tuple[bytes, str]] = []  # name and path of those copies that are open
    for row in chain(_rows(batches), [None]):
        if not alike(now, row):
            shared: dict[bool, list[bool]] = {}  # by whether the page before is the nearer one
            for name, path in waiting:
                first = bool(last and last[1] == now[1]) and not (row and row[1] == now[1] and nearness(row[2], path) > nearness(last[2], path))
                if first not in shared:
                    gone = set(deleted(now, last, None) if first else deleted(now, None, row))
                    shared[first] = [i not in gone for i in range(len(now[5]))] if gone else []
                if shared[first]:
                    names.append(name)
                    stays.append(shared[first])
                    if len(names) >= 1000:
                        yield out()
                        names.clear()
                        stays.clear()
            waiting.clear()
            last = now
        now = row
        if row and row[6] == 0 and row[4]:
            waiting.append((row[0], row[2]))
    yield out()


def shared_lines(light: DataFrame) -> DataFrame:
    """name of row, stays: whether each of its lines does; for rows (of LIGHT) marked open that lose any.

    Tasks hold ranges of pages in order. What a task needs of the others, four pages at most, is dealt out to it with its own
    pages, which are light (codes of lines); the driver sees where these pages are and a digest of each.
    """
    spark = light.sparkSession
    order = ["host", "path", "page_id", "name"]
    light = cut(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("target", F.spark_partition_id()))
    edges = cut(light.mapInArrow(_edges, EDGES))
    found: dict[int, list[Edge]] = {}
    for r in edges.select("task", "slot", "same").orderBy("task", "slot").toLocalIterator():
        found.setdefault(r["task"], []).append((r["task"], r["slot"], bytes(r["same"])))
    tasks = sorted(found)
    before = carried([found[t] for t in tasks])
    after = carried([found[t][::-1] for t in reversed(tasks)])[::-1]
    moves = [(t, x[0], x[1], k - 2) for t, rows in zip(tasks, before, strict=True) for k, x in enumerate(rows)]
    moves += [(t, x[0], x[1], k + 1) for t, rows in zip(tasks, after, strict=True) for k, x in enumerate(rows[::-1])]
    handed = spark.createDataFrame(moves, "target int, task int, slot int, place int").join(edges, ["task", "slot"]).select(*NAMES, "place", "target")
    own = light.select(*NAMES, F.lit(0).alias("place"), "target")
    dealt = own.unionByName(handed).repartitionById(max(tasks, default=0) + 1, F.col("target")).sortWithinPartitions("place", *order)
    return dealt.select(*NAMES, "place").mapInArrow(_differ, "name binary, stays array<boolean>")


#: Lists of lines are broadcast up to this size: a byte a line, and the rest of a row.
BROADCAST_BYTES, LINE_BYTES = 32_000_000, 64


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags, codes = pa.list_(pa.bool_()), pa.list_(pa.int64())
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), flags, codes, codes]
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            page = blocks(html or "")
            level = page.level
            texts = [t for t, _ in page.blocks]
            held = [bool(level) and k == level for _, k in page.blocks]
            lines = [line_code(t) for t in texts]
            outer = [x for x, (_, k) in zip(lines, page.blocks, strict=True) if not k]
            for column, value in zip(columns, (page_id, url, row_name(page_id, url, html), *place(url), not level, texts, held, lines, outer), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PARSED.split(", ")])


def differenced(parsed: DataFrame) -> DataFrame:
    """shared_lines() of all rows (of PARSED, written): of pages without an article among what is outside of articles, of those with one among all lines."""
    where = ["name", "host", "path", "page_id"]
    sides = {
        True: parsed.select(*where, "open", F.col("outer").alias("lines")),
        False: parsed.select(*where, (~F.col("open")).alias("open"), "lines"),
    }
    kinds = [r["open"] for r in parsed.select("open").distinct().collect()] or [True]
    return reduce(DataFrame.unionByName, [shared_lines(sides[k]) for k in kinds])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that the nearest page has, too) for every row. Each page is parsed once; what is made of it is written."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = cut(rows.mapInArrow(_parsed, PARSED))
    found = cut(differenced(parsed))
    size = found.agg(F.sum(F.size("stays") + F.lit(LINE_BYTES)).alias("bytes")).first()["bytes"] or 0
    stays = found.groupBy(F.col("name").alias("of")).agg(F.first("stays").alias("stays"))
    if size <= BROADCAST_BYTES:
        stays = F.broadcast(stays)
    both = parsed.join(stays, F.col("name") == F.col("of"), "left")
    marked = lambda flags: F.filter(F.zip_with("texts", flags, lambda line, kept: F.when(kept, line)), lambda line: line.isNotNull())
    differing = F.when(F.col("stays").isNull(), F.col("texts")).otherwise(marked("stays"))
    # the check by marks: an article stays whole, and nothing outside of it
    text = F.array_join(F.when(F.col("open"), differing).otherwise(marked("held")), "\n")
    n_shared = F.when(F.col("stays").isNull(), 0).otherwise(F.size(F.filter("stays", lambda kept: ~kept))).cast("long")
    return both.select("page_id", "url", text.alias("text"), n_shared.alias("n_shared")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
