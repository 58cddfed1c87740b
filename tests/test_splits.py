"""Files read in splits of any size: the same records, once each, with ordinals over all files."""

import bz2
import gzip
import random
import zlib

import pytest

from cellweave.sources import readers, sinks
from cellweave.sources.formats import BGZF_END, SCHEMAS, bgzf_block
from cellweave.sources.records import BATCHES, counted
from cellweave.sources.splits import Split, chained, layout, splits_of


def blocks(data: bytes, size: int) -> bytes:
    """BGZF, with an empty block here and there."""
    out = b""
    for k, at in enumerate(range(0, len(data), size)):
        out += bgzf_block(data[at : at + size]) + (bgzf_block(b"") if k % 5 == 3 else b"")
    return out + BGZF_END


def reads(seed: int, n: int = 120) -> list[tuple[str, str, str, str]]:
    """Records whose quality lines often begin with @ and +."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        length = rng.choice([1, 4, 30, 200])
        quality = "".join(rng.choice("@+I!A") for _ in range(length))
        out.append((f"@r{i} x", "".join(rng.choice("ACGTN") for _ in range(length)), rng.choice(["+", "+@r", "+r"]), rng.choice("@+I") + quality[1:]))
    return out


def text(records, end: str = "\n") -> bytes:
    return "".join(f + end for r in records for f in r).encode()


def split_rows(kind: str, paths: list, size: int, columns: list[str] | None = None, **options: str) -> list[tuple]:
    names = columns or [*SCHEMAS[kind].names, *(["bad"] if options.get("bad") else [])]
    splits = splits_of([str(p) for p in paths], size)
    splits = chained(splits, lambda todo: [(i, counted(kind, s, options)) for i, s in todo])
    out = []
    for s in splits:
        for b in BATCHES[kind](s, options, names):
            out += [tuple(r.values()) for r in b.to_pylist()]
    return out


SIZES = [37, 300, 999, 5000, 1 << 30]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_in_splits(tmp_path, size, end):
    files, wanted = [], []
    for k, pack in enumerate([lambda b: b, lambda b: blocks(b, 300), gzip.compress, bz2.compress, lambda b: b + b"@cut\nAC\n", lambda b: b[: -len(end)], lambda b: blocks(b, 64)]):
        records = reads(k, 40)
        (tmp_path / f"f{k}").write_bytes(pack(text(records, end)))
        files.append(tmp_path / f"f{k}")
        wanted += [(str(files[-1]), *r) for r in records]
    (tmp_path / "empty").write_bytes(b"")
    files.insert(2, tmp_path / "empty")
    got = split_rows("fastq", files, size)
    assert [r[1] for r in got] == list(range(len(wanted)))
    assert [(r[0], *r[2:]) for r in got] == wanted


@pytest.mark.parametrize("size", SIZES)
def test_lines_in_splits(tmp_path, size):
    rng = random.Random(size)
    files, wanted = [], []
    for k, pack in enumerate([lambda b: b, lambda b: blocks(b, 100), lambda b: b.rstrip(b"\n"), gzip.compress]):
        lines = ["x" * rng.choice([0, 1, 2, 40, 700]) + str(i) for i in range(50)]
        (tmp_path / f"f{k}").write_bytes(pack("".join(x + "\n" for x in lines).encode()))
        files.append(tmp_path / f"f{k}")
        wanted += lines
    assert [(r[1], r[2]) for r in split_rows("lines", files, size)] == list(enumerate(wanted))


@pytest.mark.parametrize("size", SIZES)
def test_leading_comments_of_several_files(tmp_path, size):
    (tmp_path / "a").write_text("#1\n#2\nx\n#y\n")
    (tmp_path / "b").write_text("#1\n" * 500)
    (tmp_path / "c").write_text("z\n")
    got = split_rows("lines", [tmp_path / n for n in "abc"], 1 << 62, comment="#")
    assert [r[1:] for r in got] == [(0, "x"), (1, "#y"), (2, "z")]


def alignments(seed: int, n: int = 90) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    header = ["@HD\tVN:1.6", *[f"@SQ\tSN:chr{i}\tLN:100000" for i in range(5)]]
    lines = []
    for i in range(n):
        length = rng.choice([4, 30, 400, 3000])
        seq, qual = "".join(rng.choice("ACGT") for _ in range(length)), "".join(chr(33 + rng.randrange(60)) for _ in range(length))
        lines.append(f"q{i}\t{rng.choice([0, 16])}\tchr{rng.randrange(5)}\t{i + 1}\t60\t{length}M\t*\t0\t0\t{seq}\t{qual}\tCB:Z:{rng.choice('ACGT') * 8}\tNH:i:{rng.randrange(3)}\tXX:B:c,1,{i}")
    return header, lines


def as_bam(spark_free_rows: list[dict], header: list[str], size: int) -> bytes:
    """A BAM file in blocks of some size, without a Spark job."""
    import struct

    from cellweave.sources.formats import bam_record

    names = [h.split("\t")[1][3:] for h in header if h.startswith("@SQ")]
    top = "".join(h + "\n" for h in header).encode()
    data = b"BAM\1" + struct.pack("<i", len(top)) + top + struct.pack("<i", len(names))
    for n in names:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 100000)
    references = {n: i for i, n in enumerate(names)}
    return blocks(data + b"".join(bam_record(r, references) for r in spark_free_rows), size)


@pytest.mark.parametrize("size", [211, 999, 20_000, 1 << 30])
@pytest.mark.parametrize("block", [120, 4000, 65_000])
def test_bam_and_sam_in_splits(tmp_path, size, block):
    files, wanted = [], []
    for k in range(3):
        header, lines = alignments(k, 60 if k else 25)
        (tmp_path / f"{k}.sam").write_text("\n".join([*header, *lines]) + "\n")
        rows = [dict(zip(SCHEMAS["sam"].names, r, strict=True)) for r in split_rows("sam", [tmp_path / f"{k}.sam"], 1 << 30)]
        for r in rows:
            r["tags"], r["tag_types"] = dict(r["tags"]), dict(r["tag_types"])
        (tmp_path / f"{k}.bam").write_bytes(as_bam(rows, header, block))
        files.append(f"{k}")
        wanted += [tuple(r.values())[2:] for r in rows]
    assert layout(str(tmp_path / "0.bam")) == "blocks"
    tidy = lambda r: tuple(dict(x) if isinstance(x, list) and x and isinstance(x[0], tuple) else x for x in r)
    for kind in ("bam", "sam"):
        got = split_rows(kind, [tmp_path / f"{k}.{kind}" for k in files], size)
        assert [r[1] for r in got] == list(range(len(wanted)))
        assert [tidy(r[2:]) for r in got] == wanted


def test_wanted_columns_only(tmp_path):
    header, lines = alignments(3)
    (tmp_path / "x.sam").write_text("\n".join([*header, *lines]) + "\n")
    rows = [dict(zip(SCHEMAS["sam"].names, r, strict=True)) for r in split_rows("sam", [tmp_path / "x.sam"], 1 << 30)]
    (tmp_path / "x.bam").write_bytes(as_bam([r | {"tags": dict(r["tags"]), "tag_types": dict(r["tag_types"])} for r in rows], header, 5000))
    for kind in ("sam", "bam"):
        assert split_rows(kind, [tmp_path / f"x.{kind}"], 3000, ["flag", "rec", "CB"]) == [(r["flag"], r["rec"], r["CB"]) for r in rows]


def test_wrong_guesses_are_counted_again(tmp_path):
    """A sequence of bytes in a tag that looks like records: the chain of splits finds it out."""
    header, lines = alignments(5, 12)
    (tmp_path / "x.sam").write_text("\n".join([*header, *lines]) + "\n")
    rows = [dict(zip(SCHEMAS["sam"].names, r, strict=True)) for r in split_rows("sam", [tmp_path / "x.sam"], 1 << 30)]
    from cellweave.sources.formats import bam_record

    short = next(r for r in rows if len(r["seq"]) == 4)
    bait = bam_record(short | {"tags": {}, "tag_types": {}}, {f"chr{i}": i for i in range(5)}) * 20
    for r in rows:
        r["tags"], r["tag_types"] = {"XB": "C," + ",".join(map(str, bait))}, {"XB": "B"}
    (tmp_path / "x.bam").write_bytes(as_bam(rows, header, 700))
    got = split_rows("bam", [tmp_path / "x.bam"], 2000, ["rec", "qname"])
    assert got == [(i, r["qname"]) for i, r in enumerate(rows)]


def test_broken_files(tmp_path):
    header, lines = alignments(6, 30)
    (tmp_path / "x.sam").write_text("\n".join([*header, *lines]) + "\n")
    rows = [dict(zip(SCHEMAS["sam"].names, r, strict=True)) for r in split_rows("sam", [tmp_path / "x.sam"], 1 << 30)]
    for r in rows:
        r["tags"], r["tag_types"] = dict(r["tags"]), dict(r["tag_types"])
    whole = as_bam(rows, header, 700)
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises((EOFError, ValueError), match="cut off|no block"):
        split_rows("bam", [tmp_path / "cut.bam"], 1 << 30)
    (tmp_path / "no.bam").write_bytes(gzip.compress(b"something else, long enough"))
    with pytest.raises(ValueError, match="not a BAM file"):
        split_rows("bam", [tmp_path / "no.bam"], 1 << 30)
    assert zlib.crc32(b"") == 0


# bad records


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("pack", [lambda b: b, lambda b: blocks(b, 200)])
def test_bad_records_are_rows(tmp_path, size, pack):
    records = reads(1, 60)
    lines = [list(r) for r in records]
    lines[5][0] = "r5 without a mark"
    lines[17] = lines[17][:3]  # a line is missing
    lines[30][3] += "I"
    lines[31] = [*lines[31], "one more line", "and another"]
    lines[59] = lines[59][:2]
    data = "".join(x + "\n" for r in lines for x in r).encode()
    (tmp_path / "f").write_bytes(pack(data))
    (tmp_path / "g").write_bytes(text(reads(2, 3)))
    got = split_rows("fastq", [tmp_path / "f", tmp_path / "g"], size, bad="keep")
    assert [r[1] for r in got] == list(range(64))
    bad = {r[1]: r[6] for r in got if r[6]}
    # the two lines too many are a record of their own
    assert bad == {5: "the name doesn't start with @", 17: "the record is cut off", 30: "sequence and quality differ in length", 32: "the name doesn't start with @", 60: "the record is cut off"}
    fine = [r[2:6] for r in got if not r[6]]
    assert fine == [r for i, r in enumerate(records) if i not in (5, 17, 30, 59)] + reads(2, 3)
    if size > 1000:
        with pytest.raises(ValueError, match="doesn't start with @"):
            split_rows("fastq", [tmp_path / "f"], 1 << 30)


@pytest.mark.parametrize("size", SIZES)
def test_bad_records_in_a_row_are_counted_one_by_one(tmp_path, size):
    records = reads(4, 30)
    lines = [list(r) for r in records]
    for i in (3, 4, 5, 20):
        lines[i][0] = lines[i][0][1:]
    lines[21] = lines[21][:3]
    (tmp_path / "f").write_bytes("".join(x + "\n" for r in lines for x in r).encode())
    got = split_rows("fastq", [tmp_path / "f"], size, bad="keep")
    assert [r[1] for r in got] == list(range(30)) and [r[1] for r in got if r[6]] == [3, 4, 5, 20, 21]
    assert [r[2:6] for r in got if not r[6]] == [r for i, r in enumerate(records) if i not in (3, 4, 5, 20, 21)]


def test_garbage_is_cut_into_rows(tmp_path, monkeypatch):
    from cellweave.sources import records

    monkeypatch.setattr(records, "GARBAGE", 1000)
    (tmp_path / "f").write_bytes(text(reads(1, 2)) + b"garbage\n" * 2000 + text(reads(2, 2)))
    got = split_rows("fastq", [tmp_path / "f"], 1 << 30, bad="keep")
    assert [r[2:6] for r in got if not r[6]] == reads(1, 2) + reads(2, 2)
