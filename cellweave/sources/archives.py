"""Count archives (compressed sparse rows in .npz, names in .npy) that many tasks write.

Rows are dealt out in blocks of equal numbers; a task deflates its block's part of each array and ends it at a byte without
ending the stream, so that parts one after the other are one deflate stream, whose checksum is made of theirs. The driver only copies
the parts between the archive's headers; it holds a few numbers a block.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raw import located

#: Entries from which on pointers have 64 bits.
WIDE = 1 << 31
#: Rows of a block, at least.
BLOCK_ROWS = 4096
#: The checksum's polynomial, bits reversed; a deflate stream's empty last block.
POLYNOMIAL, DEFLATE_END = 0xEDB88320, b"\x03\x00"


@dataclass(frozen=True)
class Part:
    """Deflated bytes (as they are or in a file): checksum and number of the plain ones, number of the deflated ones."""

    crc: int
    plain: int
    packed: int
    data: bytes = b""
    path: str = ""


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits, modulo the checksum's; the highest bit is the constant."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
        bit >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC32 of two pieces of bytes one after the other, of those of each and the length of the second."""
    shift, square = 1 << 31, 1 << 23  # 1, and x to the eighth
    while length:
        if length & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        length >>= 1
    return _times(shift, first) ^ second


def deflated(plain: bytes) -> Part:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = squeeze.compress(plain) + squeeze.flush(zlib.Z_FULL_FLUSH)
    return Part(zlib.crc32(plain), len(plain), len(data), data)


def array_header(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    held = io.BytesIO()
    np.lib.format.write_array_header_1_0(held, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": shape})
    return held.getvalue()


def _copied(out, parts: Iterable[Part]) -> None:  # noqa: ANN001
    for p in parts:
        if p.path:
            system, inner = located(p.path)
            with system.open_input_file(inner) as f:
                while data := f.read(8 << 20):
                    out.write(data)
        else:
            out.write(p.data)


def write_zip(out, members: dict[str, list[Part]]) -> None:  # noqa: ANN001
    """A ZIP64 archive of members, each the join of its parts."""
    directory, at = b"", 0
    for name, parts in members.items():
        crc = plain = 0
        for p in parts:
            crc, plain = joined_crc(crc, p.crc, p.plain), plain + p.plain
        packed = sum(p.packed for p in parts) + len(DEFLATE_END)
        raw = name.encode()
        # sizes are in the extra field 1, as 64 bits
        head = struct.pack("<HHHHHIIIHH", 45, 0, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, plain, packed)
        directory += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF) + raw + struct.pack("<HHQQQ", 1, 24, plain, packed, at)
        out.write(b"PK\x03\x04" + head)
        _copied(out, [*parts, Part(0, 0, 0, DEFLATE_END)])
        at += 4 + len(head) + packed
    n = len(members)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
    out.write(directory + end + b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(directory), 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


MADE = "block int, name string, crc long, plain long, packed long, path string"


def _stored(folder: str, name: str, block: int, part: Part) -> tuple:
    system, inner = located(folder)
    system.create_dir(inner)
    path = f"{folder}/{name}-{block}-{uuid.uuid4().hex}"
    with system.open_output_stream(located(path)[1], compression=None) as out:
        out.write(part.data)
    return block, name, part.crc, part.plain, part.packed, path


def _made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[x.split()[0] for x in MADE.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The number columns of a task's batches."""
    found = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) if found else np.empty(0, np.int64) for i in range(4)]


def _block_arrays(batches: Iterator[pa.RecordBatch], width: int, rows: int, starts: dict[int, int], wide: bool, folder: str) -> Iterator[pa.RecordBatch]:
    """block, row, column, n in order: the block's part of each array as files. A task has one block."""
    blocks, row, column, n = _gathered(batches)
    if not len(blocks):
        return
    number = np.int64 if wide else np.int32
    block = int(blocks[0])
    if len(n) and (n.min() < 0 or n.max() >= 1 << 32):
        raise ValueError("a count doesn't fit 32 bits")
    of = row[row >= 0] - block * width
    # the pointer behind each of the block's rows
    behind = starts[block] + np.cumsum(np.bincount(of, minlength=min(width, rows - block * width)))
    kept = row >= 0
    arrays = {"indices": column[kept].astype(number), "indptr": behind.astype(number), "data": n[kept].astype(np.uint32)}
    yield _made([_stored(folder, k, block, deflated(v.tobytes())) for k, v in arrays.items()])


def _block_names(batches: Iterator[pa.RecordBatch], letters: int, folder: str) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    if found:
        names = np.array([x for b in found for x in b.column(1).to_pylist()], f"<U{letters}")
        plain = names.tobytes()
        yield _made([_stored(folder, "names", found[0].column(0)[0].as_py(), Part(0, len(plain), len(plain), plain))])


def _parts(rows: Iterable, name: str) -> list[Part]:
    return [Part(r["crc"], r["plain"], r["packed"], path=r["path"]) for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["block"])]


def _write_names(names: DataFrame, what: str, total: int, path: str, folder: str) -> None:
    """An array of the names in the order of their index."""
    letters = names.agg(F.max(F.length(what))).first()[0] or 1
    width = max(BLOCK_ROWS, -(-total // 10_000))
    dealt = names.select(F.floor(F.col(f"{what}_index") / width).cast("int").alias("block"), what, f"{what}_index")
    dealt = dealt.repartitionById(max(1, -(-total // width)), F.col("block")).sortWithinPartitions(f"{what}_index").select("block", what)
    made = dealt.mapInArrow(partial(_block_names, letters=letters, folder=folder), MADE).collect()
    system, inner = located(path)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(array_header(np.dtype(f"<U{letters}"), (total,)))
        _copied(out, _parts(made, "names"))


def write_archive(entries: DataFrame, cells: DataFrame, genes: DataFrame, prefix: str) -> None:
    """<prefix>.npz of cell_index, gene_index, n, and the names of rows (cell, cell_index) and columns (gene, gene_index); indices are dense."""
    n_rows, n_columns = cells.count(), genes.count()
    width = max(BLOCK_ROWS, -(-n_rows // 10_000))
    blocks = max(1, -(-n_rows // width))
    folder = f"{prefix}.parts-{uuid.uuid4().hex}"
    dealt = entries.select(F.floor(F.col("cell_index") / width).cast("int").alias("block"), F.col("cell_index").cast("long").alias("row"), F.col("gene_index").cast("long").alias("column"), F.col("n").cast("long").alias("n"))
    starts, total = {}, 0
    sizes = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    for b in range(blocks):
        starts[b] = total
        total += sizes.get(b, 0)
    wide = total >= WIDE
    # a row of no entry for each block, so that blocks without entries have pointers
    marks = entries.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), *[F.lit(-1).cast("long").alias(c) for c in ("row", "column", "n")])
    held = dealt.unionByName(marks).repartitionById(blocks, F.col("block")).sortWithinPartitions("row", "column")
    # the row without an entry isn't a count
    held = held.select("block", "row", "column", F.when(F.col("row") < 0, 0).otherwise(F.col("n")).alias("n"))
    try:
        made = held.mapInArrow(partial(_block_arrays, width=width, rows=n_rows, starts=starts, wide=wide, folder=folder), MADE).collect()  # three rows a block
        number = np.dtype(np.int64 if wide else np.int32)
        top = lambda kind, n: deflated(array_header(kind, (n,)))
        small = lambda x: [deflated(array_header(x.dtype, x.shape) + x.tobytes())]
        zero = deflated(np.zeros(1, number).tobytes())
        members = {
            "indices.npy": [top(number, total), *_parts(made, "indices")],
            "indptr.npy": [top(number, n_rows + 1), zero, *_parts(made, "indptr")],
            "format.npy": small(np.array(b"csr")),
            "shape.npy": small(np.array([n_rows, n_columns])),
            "data.npy": [top(np.dtype(np.uint32), total), *_parts(made, "data")],
        }
        system, inner = located(f"{prefix}.npz")
        with system.open_output_stream(inner, compression=None) as out:
            write_zip(out, members)
        _write_names(cells, "cell", n_rows, f"{prefix}_row_index.npy", folder)
        _write_names(genes, "gene", n_columns, f"{prefix}_col_index.npy", folder)
    finally:
        system, inner = located(folder)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)
