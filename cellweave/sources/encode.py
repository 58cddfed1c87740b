"""Alignments of Arrow batches as SAM lines and BAM records, a column at a time."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import TEXT_TAGS
from .records import BAM_BASES, BAM_OPERATIONS

#: Tags that have a column.
OWN = {*TEXT_TAGS, "NH"}
HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigar", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
CODES = np.full(256, 15, np.uint8)
CODES[np.frombuffer(BAM_BASES.encode(), np.uint8)] = np.arange(16)


class Odd(Exception):
    """A batch that only the encoding row by row gets right."""


def _scalar(x: bytes) -> pa.Scalar:
    return pa.scalar(x, pa.binary())


def _joined(*parts: pa.Array | pa.Scalar, by: bytes = b"") -> pa.Array:
    return pc.binary_join_element_wise(*parts, _scalar(by))


def _filled(a: pa.Array, missing: bytes = b"") -> pa.Array:
    return pc.fill_null(a.cast(pa.string()).cast(pa.binary()), _scalar(missing))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes as an array; ends: one more than there are."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def parts_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array without nulls and where each of its values ends, from 0."""
    ends = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _numbers(batch: pa.RecordBatch, name: str, low: int, high: int) -> np.ndarray:
    a = batch[name]
    if a.null_count:
        raise Odd
    out = a.to_numpy(zero_copy_only=False)
    if len(out) and (out.min() < low or out.max() > high):
        raise Odd
    return out


def _qualities(a: pa.Array, shift: int, missing: pa.Array | pa.Scalar) -> pa.Array:
    values = a.values.slice(a.offsets[0].as_py(), a.offsets[-1].as_py() - a.offsets[0].as_py()) if len(a) else a.values
    if values.null_count:
        raise Odd
    data, ends = values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
    if len(data) and (data.min() < 0 or data.max() + shift > (255 if not shift else 126)):
        raise Odd
    return pc.if_else(a.is_null(), missing, _binary((data + shift).astype(np.uint8), ends - ends[0]))


def _others(batch: pa.RecordBatch, encoded: Callable[[str, str, str], bytes]) -> pa.Array | pa.Scalar:
    """The tags without a column, encoded by tag, type and value."""
    if "tags" not in batch.schema.names:
        return _scalar(b"")
    tags, types = batch["tags"], batch["tag_types"] if "tag_types" in batch.schema.names else None
    flat = []
    for a in (tags, types):
        if a is None:
            flat.append(([0] * (len(tags) + 1), [], []))
            continue
        ends = a.offsets.to_numpy()
        if a.null_count and (np.diff(ends)[a.is_null().to_numpy(zero_copy_only=False)] != 0).any():
            raise Odd
        flat.append((ends.tolist(), a.keys.to_pylist(), a.items.to_pylist()))
    (ends, keys, values), (its, kinds_of, kinds) = flat
    if not OWN.isdisjoint(keys) or not OWN.isdisjoint(kinds_of):
        raise Odd
    out, known = [], {}
    for i in range(len(tags)):
        kind = dict(zip(kinds_of[its[i] : its[i + 1]], kinds[its[i] : its[i + 1]], strict=True))
        row = b""
        for k in range(ends[i], ends[i + 1]):
            one = (keys[k], kind.get(keys[k], "Z"), str(values[k]))
            if one not in known:
                known[one] = encoded(*one)
            row += known[one]
        out.append(row)
    return pa.array(out, pa.binary())


def _own(batch: pa.RecordBatch, text: Callable[[str], tuple[bytes, bytes]]) -> list[pa.Array]:
    """Tags of text that have a column: what is before and behind the value of each; nothing where there is none."""
    out = []
    for t in TEXT_TAGS:
        if t in batch.schema.names:
            before, behind = text(t)
            out.append(pc.fill_null(_joined(_scalar(before), batch[t].cast(pa.string()).cast(pa.binary()), _scalar(behind)), _scalar(b"")))
    return out


def sam_lines(batch: pa.RecordBatch, encoded: Callable[[str, str, str], bytes]) -> pa.Array:
    """Lines with their ends."""
    star = lambda c: _filled(batch[c], b"*")
    number = lambda c, more: _filled(pc.add(pa.array(_numbers(batch, c, -(1 << 31), (1 << 31) - 2)), more))
    if batch["qname"].null_count:
        raise Odd
    fields = [star("qname"), number("flag", 0), star("rname"), number("pos", 1), number("mapq", 0), star("cigar"), star("rnext"), number("pnext", 1), number("tlen", 0), star("seq"), _qualities(batch["qual"], 33, _scalar(b"*"))]
    tags = _own(batch, lambda t: (f"\t{t}:Z:".encode(), b""))
    if "NH" in batch.schema.names:
        tags.append(pc.fill_null(_joined(_scalar(b"\tNH:i:"), batch["NH"].cast(pa.string()).cast(pa.binary())), _scalar(b"")))
    return _joined(_joined(*fields, by=b"\t"), *tags, _others(batch, encoded), _scalar(b"\n"))


def _cigars(a: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Encoded operations, how many, and how many places of the reference they take: each distinct text is parsed once."""
    coded = pc.fill_null(a.cast(pa.string()), "").dictionary_encode()
    found = [[(int(n), BAM_OPERATIONS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)] for text in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy()
    encoded = pa.array([struct.pack(f"<{len(f)}I", *(n << 4 | op for n, op in f)) for f in found], pa.binary())
    spans = np.array([sum(n for n, op in f if BAM_OPERATIONS[op] in "MDN=X") or 1 for f in found], np.int64)
    return encoded.take(coded.indices), np.array([len(f) for f in found], np.int64)[at], spans[at]


def _packed(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Two bases a byte, and how many bases."""
    data, ends = parts_of(pc.fill_null(pc.utf8_upper(a.cast(pa.string())), "").cast(pa.binary()))
    if len(data) and data.max() > 127:
        raise Odd
    sizes = np.diff(ends)
    starts = np.concatenate(([0], np.cumsum((sizes + 1) // 2 * 2)))
    codes = np.zeros(starts[-1], np.uint8)
    codes[np.arange(len(data)) + np.repeat(starts[:-1] - ends[:-1], sizes)] = CODES[data]
    return _binary(codes[0::2] << 4 | codes[1::2], starts // 2), sizes


def _references(a: pa.Array, references: dict[str, int]) -> np.ndarray:
    coded = a.cast(pa.string()).dictionary_encode()
    table = np.array([*[references.get(n, -1) for n in coded.dictionary.to_pylist()], -1], np.int64)
    return table[pc.fill_null(coded.indices, len(table) - 1).to_numpy(zero_copy_only=False)]


def bam_records(batch: pa.RecordBatch, references: dict[str, int], encoded: Callable[[str, str, str], bytes]) -> pa.Array:
    if batch["qname"].null_count:
        raise Odd
    n = batch.num_rows
    name = _joined(batch["qname"].cast(pa.binary()), _scalar(b"\0"))
    cigar, operations, span = _cigars(batch["cigar"])
    seq, bases = _packed(batch["seq"])
    unknown = _binary(np.full(int(bases.sum()), 255, np.uint8), np.concatenate(([0], np.cumsum(bases))))
    parts = [name, cigar, seq, _qualities(batch["qual"], 0, unknown), *_own(batch, lambda t: (t.encode() + b"Z", b"\0"))]
    if "NH" in batch.schema.names:
        hits = np.zeros(n, np.dtype([("head", "S3"), ("n", "<i4")]))
        hits["head"], hits["n"] = b"NHi", pc.fill_null(batch["NH"], 0).to_numpy(zero_copy_only=False)
        parts.append(pc.if_else(batch["NH"].is_null(), _scalar(b""), _binary(hits, np.arange(n + 1) * 7)))
    others = _others(batch, encoded)
    if isinstance(others, pa.Array):
        parts.append(others)
    i32 = (-(1 << 31), (1 << 31) - 1)
    head, names = np.zeros(n, HEAD), pc.binary_length(name).to_numpy()
    if n and (names.max() > 255 or operations.max() > 65535):
        raise Odd
    ref, pos = _references(batch["rname"], references), _numbers(batch, "pos", *i32).astype(np.int64)
    mate = np.where(pc.fill_null(pc.equal(batch["rnext"].cast(pa.string()), "="), False).to_numpy(zero_copy_only=False), ref, _references(batch["rnext"], references))
    first = np.maximum(pos, 0)
    last, bins = first + span - 1, np.zeros(n, np.int64)
    for shift in (26, 23, 20, 17, 14):
        bins = np.where(first >> shift == last >> shift, ((1 << 29 - shift) - 1) // 7 + (first >> shift), bins)
    if n and bins.max() > 65535:
        raise Odd
    body = 32 + sum(pc.binary_length(p).to_numpy().astype(np.int64) for p in parts)
    for field, values in {
        "size": body, "ref": ref, "pos": pos, "name": names, "mapq": _numbers(batch, "mapq", 0, 255), "bin": bins, "cigar": operations, "flag": _numbers(batch, "flag", 0, 65535),
        "seq": bases, "mate": mate, "mate_pos": _numbers(batch, "pnext", *i32), "tlen": _numbers(batch, "tlen", *i32),
    }.items():
        head[field] = values
    return _joined(_binary(head, np.arange(n + 1) * HEAD.itemsize), *parts)
