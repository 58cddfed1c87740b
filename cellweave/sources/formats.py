"""Spark data sources "lines", "fastq", "sam" and "bam".

Large plain files and files of BGZF blocks are read by many tasks, a split each (see splits); others by one. Files are read as streams,
and rows go to Spark as Arrow batches; gzip, bzip2 and plain files are told apart by their first bytes. Column rec is the
ordinal over all files in their order: dense if the splits were counted (readers does that), else it keeps the order only. The option
columns names the ones to read: nothing else is decoded. Register with register(spark).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schema import ALIGNMENTS, FASTQ, TEXT_TAGS
from .encode import Odd, bam_records, parts_of, sam_lines
from .raw import located
from .records import BAM_BASES, BAM_NUMBERS, BAM_OPERATIONS, BATCHES
from .splits import INDEX, Split, loaded, splits_of

#: Fixed value: the empty last block of a file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BGZF_BLOCK = 0xFF00


class SplitPart(InputPartition):
    def __init__(self, split: Split):
        self.split = split


class SplitReader(DataSourceReader):
    """One partition per split; batches by a function of the split."""

    def __init__(self, kind: str, options: dict, names: list[str]):
        given = options.get("paths") or options.get("path")
        if not given:
            raise ValueError("no path")
        self.paths = json.loads(given) if given.startswith("[") else [given]
        self.splits = options.get("splits")
        self.kind, self.options, self.names = kind, {k: v for k, v in options.items() if k not in ("splits", "paths")}, names

    def __getstate__(self) -> dict:
        """A task gets its own split, not the list of all of them."""
        return self.__dict__ | {"splits": None, "paths": []}

    def partitions(self) -> list[SplitPart]:
        return [SplitPart(s) for s in (loaded(self.splits) if self.splits else splits_of(self.paths))]

    def read(self, partition: SplitPart | None) -> Iterator:
        """partition: None where there is no split."""
        if partition is None:
            return
        yield from BATCHES[self.kind](partition.split, self.options, self.names)


def row_tags(row) -> list[tuple[str, str, str]]:  # noqa: ANN001
    """Tag, type and value; text where no type is known."""
    tags = {t: row[t] for t in (*TEXT_TAGS, "NH") if t in row and row[t] is not None}
    tags |= dict((row["tags"] if "tags" in row else None) or {})
    kinds = dict((row["tag_types"] if "tag_types" in row else None) or {})
    return [(t, kinds.get(t, "i" if t == "NH" else "Z"), str(v)) for t, v in tags.items()]


#: Fixed value: the least and the largest number of each of the binary format's integer types.
INTEGERS = {"c": (-(1 << 7), 1 << 7), "C": (0, 1 << 8), "s": (-(1 << 15), 1 << 15), "S": (0, 1 << 16), "i": (-(1 << 31), 1 << 31), "I": (0, 1 << 32)}


def sam_tag(tag: str, kind: str, value: str) -> str:
    return f"{tag}:{'i' if kind in INTEGERS else kind}:{value}"


def bam_tag(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode()
    if kind in INTEGERS:
        number = int(value)
        if not INTEGERS[kind][0] <= number < INTEGERS[kind][1]:
            kind = next(k for k, (low, high) in INTEGERS.items() if low <= number < high)
        return head + kind.encode() + struct.pack("<" + BAM_NUMBERS[kind], number)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        inner, *numbers = value.split(",")
        packed = struct.pack(f"<{len(numbers)}{BAM_NUMBERS[inner]}", *map(float if inner == "f" else int, numbers))
        return head + b"B" + inner.encode() + struct.pack("<I", len(numbers)) + packed
    if kind == "A":
        return head + b"A" + value.encode()[:1]
    return head + kind.encode() + value.encode() + b"\0"


def sam_line(row) -> str:  # noqa: ANN001
    star = lambda x: "*" if x is None else str(x)
    qual = "*" if row["qual"] is None else "".join(chr(q + 33) for q in row["qual"])
    fields = [row["qname"], row["flag"], star(row["rname"]), row["pos"] + 1, row["mapq"], star(row["cigar"]), star(row["rnext"]), row["pnext"] + 1, row["tlen"], star(row["seq"]), qual]
    return "\t".join([*map(str, fields), *[sam_tag(*t) for t in row_tags(row)]])


def bin_of(start: int, end: int) -> int:
    """The smallest of the format's nested bins that holds an interval."""
    end -= 1
    for shift in (14, 17, 20, 23, 26):
        if start >> shift == end >> shift:
            return ((1 << 29 - shift) - 1) // 7 + (start >> shift)
    return 0


def bam_record(row, references: dict[str, int]) -> bytes:  # noqa: ANN001
    import re

    cigar = [(int(n), BAM_OPERATIONS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    span = sum(n for n, op in cigar if BAM_OPERATIONS[op] in "MDN=X") or 1
    seq = row["seq"] or ""
    codes = [BAM_BASES.index(c) if c in BAM_BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = bytes(row["qual"]) if row["qual"] is not None else b"\xff" * len(seq)
    ref = references.get(row["rname"], -1)
    mate = ref if row["rnext"] == "=" else references.get(row["rnext"], -1)
    name = row["qname"].encode() + b"\0"
    tags = b"".join(bam_tag(*t) for t in row_tags(row))
    start = max(row["pos"], 0)
    body = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], bin_of(start, start + span), len(cigar), row["flag"], len(seq), mate, row["pnext"], row["tlen"])
    body += name + struct.pack(f"<{len(cigar)}I", *(n << 4 | op for n, op in cigar)) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def sam_array(batch: pa.RecordBatch) -> pa.Array:
    """The lines of a batch, with their ends."""
    try:
        return sam_lines(batch, lambda *tag: b"\t" + sam_tag(*tag).encode())
    except Odd:
        return pa.array([sam_line(row).encode() + b"\n" for row in batch.to_pylist()], pa.binary())


def bam_array(batch: pa.RecordBatch, references: dict[str, int]) -> pa.Array:
    """The records of a batch."""
    try:
        return bam_records(batch, references, bam_tag)
    except Odd:
        return pa.array([bam_record(row, references) for row in batch.to_pylist()], pa.binary())


def bgzf_block(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


#: Compressed bytes that an entry of an index stands for, about; references that an entry names at most (None: any).
STRETCH, NAMED = 1 << 20, 64


class Blocks:
    """Records as BGZF blocks, each begun with a record unless one is larger than a block; entries of an index: offset, records, references."""

    def __init__(self, out):  # noqa: ANN001
        self.out, self.held, self.at, self.entries = out, bytearray(), 0, []

    def flush(self) -> None:
        while self.held:
            block = bgzf_block(bytes(self.held[:BGZF_BLOCK]))
            self.out.write(block)
            self.at += len(block)
            del self.held[:BGZF_BLOCK]

    def add_all(self, records: pa.Array, references: list[str | None]) -> None:
        """Many records, as add() has them one by one."""
        data, ends = parts_of(records)
        data, k = memoryview(data), 0
        while k < len(records):
            n = int(np.searchsorted(ends, ends[k] + BGZF_BLOCK - len(self.held), "right")) - 1 - k
            if n <= 0:
                self.add(bytes(data[ends[k] : ends[k + 1]]), references[k])
                k += 1
                continue
            if not self.held and (not self.entries or self.at - self.entries[-1][0] >= STRETCH):
                self.entries.append([self.at, 0, []])
            self.held += data[ends[k] : ends[k + n]]
            self.entries[-1][1] += n
            for reference in dict.fromkeys(references[k : k + n]):
                self._names(reference)
            k += n

    def _names(self, reference: str | None) -> None:
        entry = self.entries[-1]
        if entry[2] is not None and reference not in entry[2]:
            entry[2] = [*entry[2], reference] if len(entry[2]) < NAMED else None

    def add(self, record: bytes, reference: str | None) -> None:
        if self.held and len(self.held) + len(record) > BGZF_BLOCK:
            self.flush()
        if not self.held and (not self.entries or self.at - self.entries[-1][0] >= STRETCH):
            self.entries.append([self.at, 0, []])
        self.held += record
        self.entries[-1][1] += 1
        self._names(reference)


class AlignmentWriter(DataSourceArrowWriter):
    """A SAM or BAM file per partition, named part-<partition>-<attempt>, those that lost are deleted. header: JSON list of lines.

    blocks: SAM lines in the blocks that BAM files have (BGZF), which readers can enter anywhere.

    single: one BAM file instead, of all partitions in order. Tasks write their blocks beside it; the commit puts them one after the other
    as they are, between one header and one end, and writes an index (<file>.index: where records begin, their ordinals and references).
    """

    def __init__(self, kind: str, options: dict, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite
        self.header = json.loads(options.get("header", "[]"))
        self.single = options.get("single") == "true"
        if self.single and kind != "bam":
            raise ValueError("one file of all partitions: BAM only")
        self.packed = kind == "sam" and options.get("blocks") == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}" if self.single else self.path

    def references(self) -> dict[str, tuple[int, int]]:
        """Number and length by name."""
        out: dict[str, tuple[int, int]] = {}
        for line in self.header:
            if line.startswith("@SQ"):
                found = dict(f.split(":", 1) for f in line.split("\t")[1:])
                out[found["SN"]] = (len(out), int(found["LN"]))
        return out

    def head(self) -> bytes:
        """The header of a BAM file, in blocks of its own."""
        text, places = "".join(h + "\n" for h in self.header).encode(), self.references()
        held = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(places))
        for n, (_, length) in places.items():
            held += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
        return b"".join(bgzf_block(held[at : at + BGZF_BLOCK]) for at in range(0, len(held), BGZF_BLOCK))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = located(self.folder)
        system.create_dir(folder)
        done = WriterCommitMessage()
        done.name, done.part, done.entries = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}{'.gz' if self.packed else ''}", context.partitionId(), []
        with system.open_output_stream(done.name, compression=None) as out:
            if self.packed:
                held = bytearray("".join(h + "\n" for h in self.header).encode())
                for batch in iterator:
                    held += memoryview(parts_of(sam_array(batch))[0])
                    whole = len(held) // BGZF_BLOCK * BGZF_BLOCK
                    for at in range(0, whole, BGZF_BLOCK):
                        out.write(bgzf_block(bytes(held[at : at + BGZF_BLOCK])))
                    del held[:whole]
                if held:
                    out.write(bgzf_block(bytes(held)))
                out.write(BGZF_END)
            elif self.kind == "sam":
                out.write("".join(h + "\n" for h in self.header).encode())
                for batch in iterator:
                    out.write(memoryview(parts_of(sam_array(batch))[0]))
            else:
                numbers = {n: i for n, (i, _) in self.references().items()}
                if not self.single:
                    out.write(self.head())
                blocks = Blocks(out)
                for batch in iterator:
                    blocks.add_all(bam_array(batch, numbers), batch["rname"].to_pylist())
                blocks.flush()
                done.entries = blocks.entries
                if not self.single:
                    out.write(BGZF_END)
        return done

    def commit(self, messages: list) -> None:
        """Only committed files stay: others are of lost attempts, or with overwrite of earlier writes."""
        from pyarrow import fs

        kept = {m.name: m for m in messages if m is not None}
        if self.single:
            self._join(sorted(kept.values(), key=lambda m: m.part))
            return
        system, folder = located(self.folder)
        parts = {n.rsplit("-", 1)[0] for n in kept}
        if not kept:
            return
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.path not in kept and f.base_name.startswith("part-") and (self.overwrite or f.path.rsplit("-", 1)[0] in parts):
                system.delete_file(f.path)

    def _join(self, parts: list) -> None:
        system, target = located(self.path)
        head, at, rec, entries = self.head(), 0, 0, []
        with system.open_output_stream(target, compression=None) as out:
            out.write(head)
            at = len(head)
            for m in parts:
                for offset, n, names in m.entries:
                    entries.append([at + offset, rec, n, names])
                    rec += n
                with system.open_input_file(m.name) as part:
                    while data := part.read(8 << 20):
                        out.write(data)
                        at += len(data)
                system.delete_file(m.name)  # at once: the blocks are never there twice
            out.write(BGZF_END)
        with system.open_output_stream(target + INDEX, compression=None) as out:
            out.write(json.dumps({"bytes": at + len(BGZF_END), "entries": entries}).encode())
        if parts:
            system.delete_dir(located(self.folder)[1])

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = located(self.folder)
        for m in messages:
            if m is not None and system.get_file_info(m.name).type == fs.FileType.File:  # the commit deletes what it has copied
                system.delete_file(m.name)


def _source(kind: str, fields: StructType, writes: bool = False) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> StructType:
            wanted = self.options.get("columns")
            every = fields.fields + ([StructField("bad", StringType())] if kind == "fastq" and self.options.get("bad") == "keep" else [])
            if not wanted:
                return StructType(every)
            return StructType([next(f for f in every if f.name == n) for n in json.loads(wanted)])

        def reader(self, schema: StructType) -> DataSourceReader:
            return SplitReader(kind, self.options, schema.names)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if not writes:
                raise NotImplementedError(f"{kind} can't be written")
            return AlignmentWriter(kind, dict(self.options), overwrite)

    Source.__name__ = kind.capitalize() + "Source"
    return Source


LINES = StructType([StructField("file", StringType()), StructField("rec", LongType()), StructField("line", StringType())])
SCHEMAS = {"lines": LINES, "fastq": FASTQ, "sam": ALIGNMENTS, "bam": ALIGNMENTS}
SOURCES = [_source(kind, fields, kind in ("sam", "bam")) for kind, fields in SCHEMAS.items()]


def register(spark: SparkSession) -> SparkSession:
    for s in SOURCES:
        spark.dataSource.register(s)
    return spark
