"""Records of a split: lines, FASTQ, SAM and BAM, as Arrow batches with ordinals."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa

from ..schema import TEXT_TAGS
from .raw import lines
from .splits import Found, Split, Window, first_line, line_groups

#: Rows of a batch, about.
ROWS = 8192
#: Bytes of unreadable lines that are one bad record at most.
GARBAGE = 16 << 20


def texts(values: list[bytes | None]) -> pa.Array:
    """Bytes as text; what isn't UTF-8 is replaced."""
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())


def batch(split: Split, rec: int | np.ndarray, n: int, wanted: list[str], columns: dict) -> pa.RecordBatch:
    """Columns by name (functions of no argument), of those that are wanted; file and rec (the ordinals, or the first of n) are made."""
    made = {"file": lambda: pa.array([split.path] * n, pa.string()), "rec": lambda: pa.array(np.arange(rec, rec + n) if isinstance(rec, int) else rec)} | columns
    return pa.RecordBatch.from_arrays([made[c]() for c in wanted], names=wanted)


# lines and SAM


def _line_lists(w: Window, options: dict) -> Iterator[list[bytes]]:
    """Lines of the split; those of the leading run of comments are passed over (such files are one split)."""
    mark = options.get("comment", "").encode()
    leading = bool(mark)
    for found in line_groups(w, 1, first_line(w)):
        if leading:
            n = next((i for i, x in enumerate(found) if not x.startswith(mark)), len(found))
            leading, found = n == len(found), found[n:]
        yield found


def line_batches(split: Split, options: dict, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    rec = split.rec
    for found in _line_lists(Window(split), options):
        for k in range(0, len(found), ROWS):
            part = found[k : k + ROWS]
            yield batch(split, rec, len(part), wanted, {"line": lambda part=part: texts(part)})
            rec += len(part)


def _alignment_lists(w: Window) -> Iterator[list[bytes]]:
    for found in line_groups(w, 1, first_line(w)):
        yield [x for x in found if x[:1] != b"@"]


def sam_batches(split: Split, options: dict, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    references: dict[str, int] = {}
    for _, line in lines(split.path):
        if not line.startswith("@"):
            break
        if line.startswith("@SQ"):
            references.setdefault(next(f[3:] for f in line.split("\t") if f.startswith("SN:")), len(references))
    rec = split.rec
    for found in _alignment_lists(Window(split)):
        for k in range(0, len(found), ROWS):
            rows = Alignments(wanted, references)
            for line in found[k : k + ROWS]:
                f = line.decode("utf-8", "replace").split("\t")
                none = lambda x: None if x == "*" else x
                tags = {t[:2]: (t[3], t[5:]) for t in f[11:]}
                rows.add((f[0], int(f[1]), none(f[2]), int(f[3]) - 1, int(f[4]), none(f[5]), none(f[6]), int(f[7]) - 1, int(f[8]), none(f[9])), None if f[10] == "*" else bytes(b - 33 for b in f[10].encode()), tags)
            yield rows.batch(split, rec)
            rec += rows.n


class Alignments:
    """Columns of alignments as they come in."""

    FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq")

    def __init__(self, wanted: list[str], references: dict[str, int]):
        self.wanted, self.references, self.n = wanted, references, 0
        self.rows: list[tuple] = []
        self.quals: list[bytes | None] = []
        self.found: list[dict[str, tuple[str, str]]] = []
        self.tagged = any(c in wanted for c in (*TEXT_TAGS, "NH", "tags", "tag_types"))

    def add(self, fields: tuple, qual: bytes | None, tags: dict[str, tuple[str, str]]) -> None:
        """tags: type and value of each."""
        self.rows.append(fields)
        self.quals.append(qual)
        self.found.append(tags)
        self.n += 1

    def batch(self, split: Split, rec: int | np.ndarray) -> pa.RecordBatch:
        columns = dict(zip(self.FIELDS, zip(*self.rows, strict=True) if self.rows else [()] * len(self.FIELDS), strict=True))
        numbers = {"flag", "pos", "mapq", "pnext", "tlen"}
        made = {c: lambda c=c: pa.array(columns[c], pa.int32() if c in numbers else pa.string()) for c in self.FIELDS}
        made["ref_id"] = lambda: pa.array([self.references.get(r, -1) if r else -1 for r in columns["rname"]], pa.int32())
        made["qual"] = self._qualities
        made |= {t: lambda t=t: pa.array([f[t][1] if t in f else None for f in self.found], pa.string()) for t in TEXT_TAGS}
        made["NH"] = lambda: pa.array([int(f["NH"][1]) if "NH" in f else None for f in self.found], pa.int32())
        made["tags"], made["tag_types"] = lambda: self._map(False), lambda: self._map(True)
        return batch(split, rec, self.n, self.wanted, made)

    def _qualities(self) -> pa.Array:
        sizes = [0 if q is None else len(q) for q in self.quals]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        values = np.frombuffer(b"".join(q for q in self.quals if q), np.uint8).astype(np.int32)
        if any(q is None for q in self.quals):
            offsets = pa.array(offsets, mask=np.array([q is None for q in self.quals] + [False]))
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))

    def _map(self, types: bool) -> pa.Array:
        """Types are kept of the tags without a column of their own, and where a column's isn't the usual one."""
        own = {**dict.fromkeys(TEXT_TAGS, "Z"), "NH": "i"}
        pairs = [[(t, k) for t, (k, _) in f.items() if own.get(t) != k] if types else [(t, v) for t, (_, v) in f.items() if t not in own] for f in self.found]
        offsets = pa.array([0, *accumulate(map(len, pairs))], pa.int32())
        return pa.MapArray.from_arrays(offsets, pa.array([k for p in pairs for k, _ in p], pa.string()), pa.array([v for p in pairs for _, v in p], pa.string()))


# FASTQ


def good(four: list[bytes]) -> bool:
    a, b, c, d = four
    return a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d)


def fault(lines_: list[bytes]) -> str:
    """What is wrong with the lines of a bad record."""
    if lines_[0][:1] != b"@":
        return "the name doesn't start with @"
    if len(lines_) < 4:
        return "the record is cut off"
    if lines_[2][:1] != b"+":
        return "the third line doesn't start with +"
    return "sequence and quality differ in length" if len(lines_[1].rstrip(b"\r")) != len(lines_[3].rstrip(b"\r")) else "too many lines"


def _first_read(w: Window) -> int | None:
    """Index of the first record: where two records in a row (one, at the end) have all marks of one. A quality line that begins with @ is followed by a name and a sequence, which has no +."""
    i = first_line(w)
    if i is None or w.split.at is not None or not w.split.begin:
        return i
    over = False
    while True:
        raw = bytes(w.held[i:]).split(b"\n")
        if not over or not raw[-1]:
            raw.pop()
        found = [x.rstrip(b"\r") for x in raw]
        at = i
        for p in range(len(found) - 3):
            if w.limit is not None and at > w.limit:
                return None
            enough = p + 8 <= len(found) or over
            if enough and all(good(found[q : q + 4]) for q in (p, p + 4) if q + 4 <= len(found)):
                return at
            if not enough:
                break
            at += len(raw[p]) + 1
        if over:
            return None
        over = not w.more()


#: Lines that are looked at for a run of good records.
RUN = 256


def _run(bare: list[bytes], j: int) -> int:
    """How many good records are there in a row from a line on, as far as is looked."""
    n = 0
    for a, b, c, d in zip(*(bare[j + k : j + RUN : 4] for k in range(4)), strict=False):
        if a[:1] != b"@" or c[:1] != b"+" or len(b) != len(d):
            break
        n += 1
    return n


def _reads(w: Window, keep_bad: bool) -> Iterator[tuple[list, list, list, list, list]]:
    """Names, sequences, third lines, qualities and faults (None: none) of the records of the split.

    What lies between two good records is as many bad ones as it has fours of lines, rounded, and one at least.
    """
    at = _first_read(w)
    if not keep_bad:
        for found in line_groups(w, 4, at):
            n = len(found) // 4 * 4
            names = found[0:n:4]
            if bad := next((x for x in names if x[:1] != b"@"), None):
                raise ValueError(f"{w.split.path}: a record doesn't start with @: {bad[:60]!r}")
            yield names, found[1:n:4], found[2:n:4], found[3:n:4], [None] * len(names)
        return
    if at is None:
        return
    w.drop(at)
    over = done = False
    while not done and not over:
        over = not w.more()
        cut = len(w.held) if over else w.held.rfind(b"\n") + 1
        found = bytes(w.held[:cut]).split(b"\n")
        if not found[-1]:
            found.pop()
        bare = [x.rstrip(b"\r") for x in found]
        columns: tuple[list, list, list, list, list] = ([], [], [], [], [])
        j = begin = 0
        while j < len(found):
            if w.limit is not None and begin > w.limit:
                done = True
                break
            n = _run(bare, j)
            k = j + 4 * n
            size = sum(map(len, found[j:k])) + k - j
            if n > 1 and w.limit is not None and begin + size > w.limit:
                n, k = 1, j + 4
                size = sum(map(len, found[j:k])) + 4
            if n:
                for c, values in zip(columns, [*(bare[j + i : k : 4] for i in range(4)), [None] * n], strict=True):
                    c += values
            else:
                k = next((m for m in range(j + 1, len(found) - 3) if good(bare[m : m + 4])), len(found) if over or cut - begin > GARBAGE else None)
                if k is None:
                    break
                # as many bad records as it has lines for, the last with what is over
                ends = [*range(j + 4, j + 4 * max(1, (k - j + 2) // 4), 4), k]
                for a, b in zip([j, *ends], ends):  # noqa: B905
                    for c, value in zip(columns, (bare[a][:1000], None, None, None, fault(bare[a:b]).encode()), strict=True):
                        c.append(value)
                size = sum(map(len, found[j:k])) + k - j
            begin += size
            j = k
        if columns[0]:
            yield columns
        w.drop(min(begin, cut))


def fastq_batches(split: Split, options: dict, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    rec = split.rec
    for columns in _reads(Window(split), options.get("bad") == "keep"):
        for k in range(0, len(columns[0]), ROWS):
            part = [c[k : k + ROWS] for c in columns]
            made = {name: lambda c=c: texts(c) for name, c in zip(("name", "sequence", "name2", "quality", "bad"), part, strict=True)}
            yield batch(split, rec, len(part[0]), wanted, made)
            rec += len(part[0])


# BAM

#: Fixed values of the binary format: letters of sequences and CIGAR operations, sizes of tag types.
BAM_BASES, BAM_OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
BAM_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BASE_PAIRS = [a + b for a in BAM_BASES for b in BAM_BASES]
FIXED = struct.Struct("<iiiBBHHHiiii")
#: Largest record that a split's first one is taken for, and how many in a row have to look like records.
RECORD_MOST, CHAIN = 1 << 28, 16


def bam_head(w: Window) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, names and lengths of the references, bytes of all that; of a window on the file's begin."""

    def whole(n: int) -> None:
        if not w.until(n):
            raise EOFError(f"{w.split.path} is cut off")

    whole(12)
    if w.held[:4] != b"BAM\1":
        raise ValueError(f"{w.split.path} is not a BAM file")
    (length,) = struct.unpack_from("<i", w.held, 4)
    whole(12 + length)
    text = bytes(w.held[8 : 8 + length]).rstrip(b"\0").decode()
    at, references = 12 + length, []
    for _ in range(struct.unpack_from("<i", w.held, 8 + length)[0]):
        whole(at + 4)
        (size,) = struct.unpack_from("<i", w.held, at)
        whole(at + 8 + size)
        references.append((bytes(w.held[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", w.held, at + 4 + size)[0]))
        at += 8 + size
    return text, references, at


def _plausible(w: Window, i: int, references: int) -> int:
    """Size of the record at an index, if it looks like one; 0 if it doesn't."""
    if not w.until(i + 36):
        return 0
    size, ref, pos, name, _, _, cigar, _, seq, mate, mate_pos, _ = FIXED.unpack_from(w.held, i)
    if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name >= 2 and seq >= 0 and 33 <= size <= RECORD_MOST):
        return 0
    if 32 + name + 4 * cigar + (seq + 1) // 2 + seq > size or not w.until(i + 36 + name + 4 * cigar):
        return 0
    text = w.held[i + 36 : i + 36 + name]
    if text[-1] or not all(33 <= c <= 126 for c in text[:-1]):
        return 0
    operations = struct.unpack_from(f"<{cigar}I", w.held, i + 36 + name)
    return size + 4 if all(x & 15 < 9 for x in operations) else 0


def _first_alignment(w: Window, references: int) -> int | None:
    """Index of the first record: from there on a chain of records, up to the end of the file or so many."""
    i = 0
    while not w.behind(i) and w.until(i + 36):
        at, n = i, 0
        while n < CHAIN and (size := _plausible(w, at, references)):
            at, n = at + size, n + 1
            if n == CHAIN or not w.until(at + 1):
                return i if at <= len(w.held) else None
        i += 1
    return None


def _alignment_parts(split: Split) -> Iterator[tuple[Window, list[str], bytes, list[int]]]:
    """The window, the references' names, bytes and where records begin in them."""
    w = Window(split)
    whole_file = not split.begin and split.at is None
    _, references, length = bam_head(w if whole_file else Window(Split(split.path, 0)))
    names = [n for n, _ in references]
    at = length if whole_file else 0 if split.at is not None else _first_alignment(w, len(names))
    if at is None:
        return
    w.drop(at)
    while True:
        found, i = [], 0
        while not w.behind(i) and i + 4 <= len(w.held):
            size = struct.unpack_from("<i", w.held, i)[0] + 4
            if size < 36:
                raise ValueError(f"{split.path}: a record of {size} bytes")
            if i + size > len(w.held):
                break
            found.append(i)
            i += size
        if found:
            yield w, names, bytes(w.held[:i]), found
        w.drop(i)
        if w.behind(0):
            return
        if not w.more():
            if w.held:
                raise EOFError(f"{split.path} is cut off")
            return


def bam_tags(data: bytes, at: int, end: int) -> dict[str, tuple[str, str]]:
    """Type and value of each tag, as SAM would have the value."""
    out = {}
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode("utf-8", "replace"), stop + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in BAM_NUMBERS:
            size = struct.calcsize("<" + BAM_NUMBERS[kind])
            value, at = str(struct.unpack_from("<" + BAM_NUMBERS[kind], data, at)[0]), at + size
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{BAM_NUMBERS[inner]}", data, at + 5)
            value, at = ",".join([inner, *map(str, numbers)]), at + 5 + n * struct.calcsize("<" + BAM_NUMBERS[inner])
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        out[tag] = kind, value
    return out


def bam_batches(split: Split, options: dict, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """Only what is wanted is decoded of sequences, qualities, CIGARs and tags; of the alignments to a reference only, if one is asked for."""
    before, reference = split.rec, options.get("reference")
    with_cigar, with_seq, with_qual = (c in wanted for c in ("cigar", "seq", "qual"))
    for _, names, data, found in _alignment_parts(split):
        references = {n: i for i, n in enumerate(names)}
        recs = np.arange(before, before + len(found))
        before += len(found)
        if reference is not None:
            only = references.get(reference, -2)
            here = [j for j, i in enumerate(found) if struct.unpack_from("<i", data, i + 4)[0] == only]
            recs, found = recs[here], [found[j] for j in here]
        for k in range(0, len(found), ROWS):
            rows = Alignments(wanted, references)
            for i in found[k : k + ROWS]:
                size, ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = FIXED.unpack_from(data, i)
                at = i + 36 + n_name
                qname = data[i + 36 : at - 1].decode()
                cigar = "".join([f"{x >> 4}{BAM_OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)]) if with_cigar else ""
                at += 4 * n_cigar
                half = (n_seq + 1) // 2
                seq = "".join([BASE_PAIRS[b] for b in data[at : at + half]])[:n_seq] if with_seq else ""
                at += half
                qual = data[at : at + n_seq] if with_qual else b""
                at += n_seq
                mate = "=" if next_ref == ref and ref >= 0 else None if next_ref < 0 else names[next_ref]
                tags = bam_tags(data, at, i + 4 + size) if rows.tagged else {}
                rows.add((qname, flag, None if ref < 0 else names[ref], pos, mapq, cigar or None, mate, next_pos, tlen, seq or None), None if not qual or qual[0] == 255 else qual, tags)
            yield rows.batch(split, recs[k : k + ROWS])


BATCHES = {"lines": line_batches, "fastq": fastq_batches, "sam": sam_batches, "bam": bam_batches}


def counted(kind: str, split: Split, options: dict) -> Found:
    """How many records a split has, where its first one is, and where the next split's has to be."""
    n, first, w = 0, None, None
    if kind == "bam":
        for w, _, _, found in _alignment_parts(split):
            if first is None:
                first = w.place(found[0])
            n += len(found)
    else:
        w = Window(split)
        place = _noted(w)
        if kind == "fastq":
            n = sum(len(c[0]) for c in _reads(w, options.get("bad") == "keep"))
        else:
            n = sum(map(len, _line_lists(w, options) if kind == "lines" else _alignment_lists(w)))
        first = place()
    stop = None if w is None else w.place(0)
    return Found(first, stop, w is not None and w.over and not w.held, n)


def _noted(w: Window):  # noqa: ANN202
    """The place of the first byte that is kept of a window of lines: where its first record is."""
    held, drop = [], w.drop

    def noting(n: int) -> None:
        if not held:
            w.until(n + 1)
            held.append(w.place(n))
        drop(n)

    w.drop = noting
    return lambda: held[0] if held else None
