"""Byte ranges of files, and the records that begin in them.

Plain files and files of BGZF blocks are cut into splits; other gzip and bzip2 files are one split each. A split has the records
that begin in it: lines and records of lines that begin after its first byte up to the first byte after it, BAM records
that begin in one of its blocks. Where the first record begins is guessed from the bytes; counting a file's splits proves the
guesses, since every split ends where the next one begins, and a split that was wrong is counted again from where the one before it ended.

Places are byte offsets in plain files, and offset of the block * 2**16 + offset in the block in others.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from .raw import GZIP, expanded, located, opened

#: Bytes of a split, at least; how many splits an input is cut into at most, besides one a file.
SPLIT, MOST_SPLITS = 128 << 20, 50_000
#: Bytes that are read at a time.
CHUNK = 1 << 20
#: Ordinals of a split where they are not counted: they keep the order, with gaps.
SPACE = 40
#: Ending of the name of an index beside a BAM file.
INDEX = ".index"
#: Fixed values of the block format: first bytes, head of the field with the block's size, largest block.
BLOCK_HEAD, BLOCK_FIELD, BLOCK_MOST = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 1 << 16


@dataclass(frozen=True)
class Split:
    """Bytes begin to end (None: all) of a file; number: its place in the stream; at: where its first record is, if that is known; rec: that one's ordinal."""

    path: str
    number: int
    begin: int = 0
    end: int | None = None
    at: int | None = None
    rec: int = 0


def dumped(splits: list[Split]) -> str:
    return json.dumps([list(asdict(s).values()) for s in splits])


def loaded(text: str) -> list[Split]:
    return [Split(*s) for s in json.loads(text)]


def block_size(data: bytes, at: int) -> int | None:
    """Size of the BGZF block whose head is there; None if there is none, or not all of its head."""
    if data[at : at + 4] != BLOCK_HEAD or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    field = data.find(BLOCK_FIELD, at + 12, at + 12 + extra)
    return None if field < 0 or len(data) < field + 6 else struct.unpack_from("<H", data, field + 4)[0] + 1


def plain_block(data: bytes, at: int, size: int) -> bytes:
    (extra,) = struct.unpack_from("<H", data, at + 10)
    return zlib.decompress(data[at + 12 + extra : at + size - 8], -15)


def layout(path: str) -> str:
    """plain, blocks or stream (one that can't be entered in the middle)."""
    system, inner = located(path)
    with system.open_input_file(inner) as f:
        first = f.read(64)
    if not first.startswith(GZIP) and not first.startswith(b"BZh"):
        return "plain"
    return "blocks" if block_size(first, 0) else "stream"


def splits_of(paths: list[str], size: int = SPLIT) -> list[Split]:
    """The splits of the files, in the order of the stream, with ordinals that keep the order."""
    out: list[Split] = []
    files = [(p, located(p)[0].get_file_info(located(p)[1]).size) for p in expanded(paths)]
    width = max(1, size, -(-sum(n for _, n in files) // MOST_SPLITS))
    for path, n in files:
        whole = n <= width or layout(path) == "stream"
        for begin in [0] if whole else range(0, n, width):
            end = None if whole or begin + width >= n else begin + width
            out.append(Split(path, len(out), begin, end, rec=len(out) << SPACE))
    return out


def index_of(path: str) -> list[list] | None:
    """Entries (offset, ordinal of the first record, number of records, names of their references) of the index beside a file; None if there is none, or it is of other bytes."""
    system, inner = located(path)
    if system.get_file_info(inner + INDEX).type != fs.FileType.File:
        return None
    with system.open_input_file(inner + INDEX) as f:
        found = json.loads(f.read())
    return found["entries"] if found["bytes"] == system.get_file_info(inner).size else None


def indexed_splits(paths: list[str], size: int = SPLIT, reference: str | None = None) -> list[Split] | None:
    """Splits of files that all have an index: where they begin and with which ordinal is known, nothing has to be counted.

    reference: only the stretches that have alignments to it.
    """
    out: list[Split] = []
    total = 0
    for path in expanded(paths):
        entries = index_of(path)
        if entries is None:
            return None
        n = 0
        for k, (offset, _, count, names) in enumerate(entries):
            wanted = reference is None or names is None or reference in names
            end = entries[k + 1][0] if k + 1 < len(entries) else None
            last = out[-1] if out else None
            if wanted and last and last.path == path and last.end == offset and offset - last.begin < size:
                out[-1] = replace(last, end=end)
            elif wanted:
                out.append(Split(path, len(out), offset, end, offset << 16, total + n))
            n += count
        total += n
    return out


class Window:
    """Plain bytes of a file from the start of a split on, and where the split ends in them."""

    def __init__(self, split: Split):
        self.split, self.kind = split, layout(split.path)
        self.held, self.marks = bytearray(), []
        #: Index of the first byte behind the split, once it is reached.
        self.limit: int | None = None
        self.over = False
        if self.kind == "stream":
            self.file, self.next = opened(split.path), 0
            return
        system, inner = located(split.path)
        self.file, self.size = system.open_input_file(inner), system.get_file_info(inner).size
        self.ahead = b""
        at = split.begin if split.at is None else split.at
        if self.kind == "plain":
            self.next = at
            self.file.seek(at)
            return
        self.next = self._block_from(at) if split.at is None else at >> 16
        self.file.seek(min(self.next, self.size))
        if split.at is not None:
            while len(self.held) < at & 0xFFFF and self.more():
                pass
            self.drop(at & 0xFFFF)

    def _block_from(self, begin: int) -> int:
        """Offset of the first block that begins there or later: its size leads to another block, and its bytes have the checksum they should."""
        at = begin
        while at < self.size:
            self.file.seek(at)
            data = self.file.read(4 * BLOCK_MOST)
            i = data.find(BLOCK_HEAD)
            while i >= 0:
                size = block_size(data, i)
                if size and at + i + size <= self.size and len(data) >= i + size:
                    ends = at + i + size == self.size or data[i + size : i + size + 4] == BLOCK_HEAD or len(data) < i + size + 4
                    try:
                        if ends and zlib.crc32(plain_block(data, i, size)) == struct.unpack_from("<I", data, i + size - 8)[0]:
                            return at + i
                    except zlib.error:
                        pass
                i = data.find(BLOCK_HEAD, i + 1)
                if i > 2 * BLOCK_MOST:
                    break
            at += 2 * BLOCK_MOST
        return self.size

    def more(self) -> bool:
        """Read on; False at the end of the file."""
        if self.over:
            return False
        had = len(self.held)
        end = self.split.end
        if self.kind == "blocks":
            self._blocks(end)
        else:
            data = self.file.read(CHUNK)
            if data:
                self.marks.append((had, self.next))
                if end is not None and self.limit is None and self.next + len(data) > end:
                    self.limit = had + end - self.next
                self.next += len(data)
                self.held += data
        self.over = len(self.held) == had
        return not self.over

    def _blocks(self, end: int | None) -> None:
        """Append the next blocks: some CHUNK of compressed bytes of them, more if they are all empty."""
        had = len(self.held)
        while len(self.held) == had:
            data = self.ahead + self.file.read(CHUNK)
            if not data:
                return
            at = 0
            while at < len(data):
                size = block_size(data, at)
                if size is None or at + size > len(data):
                    if len(data) - at >= BLOCK_MOST or size is None and len(data) - at >= 64:
                        raise ValueError(f"{self.split.path}: no block at byte {self.next}")
                    break
                if end is not None and self.limit is None and self.next >= end:
                    self.limit = len(self.held)
                self.marks.append((len(self.held), self.next))
                self.held += plain_block(data, at, size)
                self.next += size
                at += size
            self.ahead = data[at:]
            if self.ahead and not at and self.next + len(self.ahead) >= self.size:
                raise EOFError(f"{self.split.path} is cut off")

    def drop(self, n: int) -> None:
        """Forget the first n bytes."""
        del self.held[:n]
        k = bisect_right(self.marks, n, key=lambda m: m[0]) - 1
        self.marks = [(i - n, place) for i, place in self.marks[max(k, 0) :]]
        self.limit = None if self.limit is None else self.limit - n

    def place(self, i: int) -> int:
        """Place of the byte at an index (that of the first byte after all that is read, too)."""
        if i >= len(self.held):
            self.more()
        k = bisect_right(self.marks, i, key=lambda m: m[0]) - 1
        if k < 0:
            return self.split.begin
        start, place = self.marks[k]
        return place + i - start if self.kind != "blocks" else (place << 16) + i - start

    def behind(self, i: int) -> bool:
        """Whether an index is behind the split."""
        return self.limit is not None and i >= self.limit

    def until(self, n: int) -> bool:
        """Whether there are n bytes; reads on for them."""
        while len(self.held) < n:
            if not self.more():
                return False
        return True


@dataclass
class Found:
    """What counting a split finds: where its first record is (None: it has none), where the next split's should be, whether that is the file's end, and how many records there are."""

    first: int | None
    stop: int | None
    over: bool
    n: int


def joined(splits: list[Split], found: list[Found]) -> tuple[list[Split], list[int]]:
    """Splits with the ordinals and places of their first records, and which of them have to be counted again: those that don't begin where the one before ended."""
    out, again, total = [], [], 0
    before: Found | None = None
    for i, (s, f) in enumerate(zip(splits, found, strict=True)):
        at = f.first if f.first is not None else s.at
        if not i or splits[i - 1].path != s.path or not s.begin:
            before = f
        elif f.first is None:
            # what the split before left has to be somewhere: in a later split, or it is in this one
            if s.end is None and s.at is None and not before.over:
                again.append(i)
                at = before.stop
        elif f.first != before.stop:
            again.append(i)
            at = before.stop
            before = f
        else:
            before = f
        out.append(replace(s, at=at, rec=total))
        total += f.n
    return out, again


def chained(splits: list[Split], count: Callable[[list[tuple[int, Split]]], Iterable[tuple[int, Found]]]) -> list[Split]:
    """Splits with dense ordinals over all files, once every split begins where the one before ended."""
    found: list[Found | None] = [None] * len(splits)
    todo = list(range(len(splits)))
    while todo:
        for i, f in count([(i, splits[i]) for i in todo]):
            found[i] = f
        splits, todo = joined(splits, found)
    return splits


def numbered(spark: SparkSession, kind: str, splits: list[Split], options: dict[str, str]) -> list[Split]:
    """chained() by a job with a task a split; the driver gets a row a split."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .records import counted

        for b in batches:
            got = [counted(kind, loaded(s)[0], options) for s in b.column(1).to_pylist()]
            columns = [pa.array([getattr(f, n) for f in got], pa.bool_() if n == "over" else pa.int64()) for n in ("first", "stop", "over", "n")]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["i", "first", "stop", "over", "n"])

    def count(todo: list[tuple[int, Split]]) -> Iterator[tuple[int, Found]]:
        rows = spark.createDataFrame([(i, dumped([s])) for i, s in todo], "i long, split string").repartition(len(todo))
        for r in rows.mapInArrow(counts, "i long, first long, stop long, over boolean, n long").collect():
            yield r["i"], Found(r["first"], r["stop"], r["over"], r["n"])

    return chained(splits, count)


# records of lines


def line_groups(w: Window, k: int, at: int | None) -> Iterator[list[bytes]]:
    """The lines of the records of k lines that begin in the split from index at on, without their ends, in lists of whole records.

    The last list has fewer lines where the file ends within a record. w then begins where the next split does.
    """
    if at is None:
        return
    w.drop(at)
    over = False
    while not over:
        over = not w.more()
        data = bytes(w.held)
        cut = len(data) if over else data.rfind(b"\n") + 1
        lines = data[:cut].split(b"\n")
        if not lines[-1]:
            lines.pop()
        keep = len(lines) if over else len(lines) // k * k
        if w.limit is not None and cut > w.limit:
            n = begin = 0
            while n < keep and begin <= w.limit:
                begin += sum(map(len, lines[n : n + k])) + k
                n += k
            keep, over = min(n, keep), over or begin > w.limit
        used = min(cut, sum(map(len, lines[:keep])) + keep)
        if keep:
            yield [x.removesuffix(b"\r") for x in lines[:keep]] if b"\r" in data else lines[:keep]
        w.drop(used)


def first_line(w: Window) -> int | None:
    """Index of the first line that begins in the split: the one that its first byte is in belongs to the split before."""
    if w.split.at is not None or not w.split.begin:
        return 0
    at = 0
    while (i := w.held.find(b"\n", at)) < 0:
        at = len(w.held)
        if not w.more():
            return None
    return None if w.limit is not None and i + 1 > w.limit else i + 1
