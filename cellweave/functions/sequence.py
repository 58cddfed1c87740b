"""Column functions on sequences, barcodes, qualities and flags: built-in expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits per base of the two encodings (the order of letters is the code).
TWO_BIT = {"A": 0, "C": 1, "T": 2, "G": 3}
THREE_BIT = {"C": 1, "A": 2, "G": 3, "T": 4, "N": 6}
TWO_BIT_LONGEST, THREE_BIT_LONGEST = 31, 21
UNMAPPED, REVERSE, DUPLICATE = 4, 16, 1024


def between(sequence: Column, start: int, end: int) -> Column:
    """Characters [start, end), as far as there are any."""
    if start < 0 or end < start:
        raise ValueError("start must be 0 or more, end not less than start")
    return F.substring(sequence, start + 1, end - start)


def read_structure(pattern: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each piece of a structure like 8C18X6C9M1X."""
    if not re.fullmatch(r"(\d+[A-Z])+", pattern):
        raise ValueError(f"not a read structure: {pattern!r}")
    out, at = [], 0
    for n, kind in re.findall(r"(\d+)([A-Z])", pattern):
        out.append((kind, at, at + int(n)))
        at += int(n)
    return out


def pieces(sequence: Column, pattern: str, kind: str) -> Column:
    """All pieces of a kind (C: cell, M: molecule), joined."""
    found = [between(sequence, a, b) for k, a, b in read_structure(pattern) if k == kind]
    return F.concat(*found) if found else F.lit("")


def letters(sequence: Column) -> Column:
    """The characters as an array: empty for an empty text."""
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def phred(quality: Column) -> Column:
    """Quality characters to numbers."""
    return F.transform(letters(quality), lambda c: F.ascii(c) - 33)


def mean_quality(quality: Column) -> Column:
    """Mean of a quality string; null for an empty one."""
    codes = phred(quality)
    return F.try_divide(F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x), F.size(codes))


def share_above(qualities: Column, threshold: int = 30) -> Column:
    """Share of numbers over the threshold; null for an empty array."""
    return F.try_divide(F.size(F.filter(qualities, lambda q: q > threshold)), F.size(qualities))


def share_above_text(quality: Column, threshold: int = 30) -> Column:
    """The same for a quality string, without making it an array; null for an empty one."""
    low = "".join(chr(33 + q) for q in range(threshold + 1))
    return F.try_divide(F.length(F.translate(quality, low, "")), F.length(quality))


def mean_of(qualities: Column) -> Column:
    return F.try_divide(F.aggregate(qualities, F.lit(0).cast("long"), lambda s, x: s + x), F.size(qualities))


def aligned_part(qualities: Column, cigar: Column) -> Column:
    """Qualities without the soft clips at either end."""
    before = F.coalesce(F.try_to_number(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.lit("999999999")).cast("int"), F.lit(0))
    after = F.coalesce(F.try_to_number(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    clipped = F.coalesce(cigar, F.lit("")).contains("S")
    return F.when(clipped, F.slice(qualities, before + 1, F.greatest(F.size(qualities) - before - after, F.lit(0)))).otherwise(qualities)


def spliced(cigar: Column) -> Column:
    """Whether a CIGAR string skips reference bases."""
    return F.coalesce(cigar.rlike(r"(^|[A-Z=])0*[1-9][0-9]*N"), F.lit(False))


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def tag_or(tag: Column, default: object, dash_is_missing: bool = False) -> Column:
    return F.coalesce(F.nullif(tag, F.lit("-")) if dash_is_missing else tag, F.lit(default))


def first_tag(*tags: Column, required: bool = False) -> Column:
    """The first tag that is there; required: an error if none is."""
    found = F.coalesce(*tags)
    return F.coalesce(found, F.raise_error(F.lit("alignment without any of the tags")).cast("string")) if required else found


def single_gene(gene: Column) -> Column:
    return F.instr(gene, ",") == 0


def encode_two_bit(sequence: Column, seed: int | None = None) -> Column:
    """A C T G as two bits each; other letters: null, or with a seed one of the four by hash of the text and place."""
    wild = F.lit(None).cast("long") if seed is None else None

    def code(c: Column, i: Column) -> Column:
        known = reduce(lambda col, kv: col.when(F.upper(c) == kv[0], F.lit(kv[1]).cast("long")), list(TWO_BIT.items())[1:], F.when(F.upper(c) == "A", F.lit(0).cast("long")))
        return known.otherwise(wild if wild is not None else F.pmod(F.xxhash64(sequence, i, F.lit(seed)), F.lit(4)))

    return F.aggregate(F.transform(letters(sequence), code), F.lit(0).cast("long"), lambda s, x: s * 4 + x)


def encode_three_bit(sequence: Column) -> Column:
    """C A G T N as three bits each, never 0; other letters count as N."""

    def code(c: Column) -> Column:
        known = reduce(lambda col, kv: col.when(F.upper(c) == kv[0], F.lit(kv[1])), list(THREE_BIT.items())[1:], F.when(F.upper(c) == "C", F.lit(1)))
        return known.otherwise(THREE_BIT["N"]).cast("long")

    return F.aggregate(F.transform(letters(sequence), code), F.lit(0).cast("long"), lambda s, x: s * 8 + x)


def decode_two_bit(code: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    places = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit("".join(TWO_BIT)), (F.call_function("shiftright", code, (i * 2).cast("int")).bitwiseAND(F.lit(3))).cast("int") + 1, F.lit(1))), "")


def decode_three_bit(code: Column) -> Column:
    """The number of bases is known from the code: no base is 0."""
    names = {v: k for k, v in THREE_BIT.items()}
    by_code = "".join(names.get(i, "N") for i in range(8))
    places = F.sequence(F.lit(THREE_BIT_LONGEST - 1), F.lit(0), F.lit(-1))
    return F.array_join(
        F.transform(
            F.filter(F.transform(places, lambda i: F.call_function("shiftright", code, (i * 3).cast("int")).bitwiseAND(F.lit(7)).cast("int")), lambda x: x != 0),
            lambda x: F.substring(F.lit(by_code), x + 1, F.lit(1)),
        ),
        "",
    )


def gc_count(sequence: Column) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, "GCgc", ""))


def gc_count_encoded(code: Column, bits: int) -> Column:
    """G and C have odd codes in both encodings: one bit in each group."""
    mask = sum(1 << bits * i for i in range(63 // bits))
    return F.bit_count(code.bitwiseAND(F.lit(mask)))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ; null for other lengths."""
    both = F.zip_with(letters(a), letters(b), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(both, F.lit(0), lambda s, x: s + x))


def hamming_encoded(a: Column, b: Column, bits: int) -> Column:
    """The same for encoded texts: groups of bits that differ."""
    mask = F.lit(sum(1 << bits * i for i in range(63 // bits)))
    x = a.bitwiseXOR(b)
    any_bit = reduce(lambda col, k: col.bitwiseOR(F.shiftright(x, k)), range(1, bits), x)
    return F.bit_count(any_bit.bitwiseAND(mask))


def entropy4(*shares: Column) -> Column:
    """Entropy of four shares, logarithm to base 4."""
    return -reduce(lambda s, p: s + F.when(p > 0, p * F.log(p) / F.log(F.lit(4.0))).otherwise(0.0), shares, F.lit(0.0))
