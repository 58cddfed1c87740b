"""Secret scans: three fixed patterns, and a randomness test battery for what they miss.

The battery takes runs of 20 or more characters of [A-Za-z0-9+/_=-] that no fixed span touches and
infers the encoding of each from its letters (hex, base32, base36 in one case, base64 and its like). Against the null hypothesis
that a run is written language, whose figures for each encoding are the constants below, it computes three p-values: that the chi-squared
distance from a uniform alphabet is as small as it is, that there are as many runs of digits and cases, and that the serial correlation of
vowels and consonants, which alternate in words, is as large. Fisher's sum joins them. In short runs and small alphabets these tests find
little, so a fourth figure stands beside their sum: the likelihood ratio of written language to a uniform alphabet, which by
Markov's inequality is at most so small by chance; what counts is the smaller of the two, doubled. Within a text the Benjamini-Hochberg rule with
weights by length bounds the share of false discoveries; texts are judged one by one, so that a row's spans don't depend on other rows.

Runs of digits alone, and of letters of one case alone, are passed over: the tests have no power there.

Defined cases: null and empty texts give no spans and the digest of the empty string; rows keep their number,
repeated or not; an empty table gives an empty table; other columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The kinds in their order, with the least length of what must be long.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is [0-9a-f]+ of 32 and more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Alphabets by name, the smallest that holds a run is taken; what a run of language would look like in it.
HEX_LETTERS, BASE32, BASE36, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FALSE_DISCOVERIES = 1e-3
#: Chance that language goes from letters to digits or back at a character (or, with both cases, to the other case).
CLASS_CHANGE = 0.08
#: Chance that two letters of words are the same (measured 0.086; less makes the test stricter), and how the correlation of vowels with the
#: next letter's is spread over runs of words put together: mean, and standard deviation times the root of the length (documents sf0.1).
LETTER_MATCH, SERIAL_MEAN, SERIAL_SPREAD = 0.075, -0.2, 0.93
#: The same by encoding. Words of the letters a to f alone repeat them more often (0.34 by the figures below) and have no rule of vowels.
MATCH = {"hex": 0.2, "base32": LETTER_MATCH, "base36": LETTER_MATCH, "base64": LETTER_MATCH}
SERIAL = {"hex": (-0.2, 1.0), "base32": (SERIAL_MEAN, SERIAL_SPREAD), "base36": (SERIAL_MEAN, SERIAL_SPREAD), "base64": (SERIAL_MEAN, SERIAL_SPREAD)}
#: Letters a to z in 1,000 letters of documents (sf0.1).
PER_MILLE = (77.2, 13.6, 19.5, 35.4, 168.9, 10.1, 13.5, 87.7, 70.3, 1.0, 1.9, 30.2, 5.8, 117.5, 66.1, 4.3, 4.4, 64.9, 42.1, 103.3, 31.8, 4.4, 9.3, 3.7, 8.5, 4.8)
LOG_LETTER = {chr(97 + i): math.log(x / sum(PER_MILLE)) for i, x in enumerate(PER_MILLE)}
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end: sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(run: str) -> tuple[str, str]:
    """Name and alphabet that a run seems to be written in."""
    bare = run.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare):
        return "hex", HEX_LETTERS
    if re.fullmatch(r"[A-Z2-7]+", bare):
        return "base32", BASE32
    if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", bare):
        return "base36", BASE36
    return "base64", BASE64


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def symbol_class(c: str) -> int:
    return 2 if c.isdigit() else int(c.isupper())


def word_classes(bare: str) -> list[int]:
    """Lower case, upper case or digit of each letter and digit; a capital before a small letter begins a word and is of its class."""
    shown = [c for c in bare if c.isalnum()]
    return [0 if c.isalpha() and d.islower() else symbol_class(c) for c, d in zip(shown, [*shown[1:], ""], strict=True)]


def language_over_uniform(bare: str, alphabet: str) -> float:
    """Likelihood ratio: letters as in the documents, any digit or sign, few changes of class."""
    classes = word_classes(bare)
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    log = len(bare) * math.log(len(alphabet)) + sum(LOG_LETTER.get(c, -math.log(10)) for c in bare.lower())
    log += changes * math.log(CLASS_CHANGE) + (len(classes) - 1 - changes) * math.log(1 - CLASS_CHANGE)
    return math.exp(min(log, 0.0))


def serial_correlation(marks: list[bool]) -> float:
    """Correlation of each mark with the next; 0 if they are all the same."""
    n, mean = len(marks), sum(marks) / max(len(marks), 1)
    spread = mean * (1 - mean)
    if n < 3 or spread == 0:
        return 0.0
    return sum((a - mean) * (b - mean) for a, b in zip(marks, marks[1:], strict=False)) / (n - 1) / spread


def battery(run: str) -> float:
    """Joint p-value of a run under the null hypothesis of written language: small for random runs."""
    name, alphabet = encoding(run)
    bare = run.rstrip("=")
    n, k = len(bare), len(alphabet)
    folded = bare.replace("-", "+").replace("_", "/")
    counts: dict[str, int] = {}
    for c in folded:
        counts[c] = counts.get(c, 0) + 1
    # chi-squared over a uniform alphabet, per letter; under language a letter's chance of meeting itself is the match
    chi = sum(v * v for v in counts.values()) * k / n - n
    delta = k * MATCH[name] - 1  # of the non-centrality, per letter
    mean, variance = (k - 1) + n * delta, 2 * (k - 1) + 4 * n * delta * (1 + delta / 2)
    p_uniform = normal_below((chi - mean) / math.sqrt(variance))
    # runs of one class, signs aside
    classes = word_classes(bare)
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    p_runs = _binomial_above(changes, len(classes) - 1, CLASS_CHANGE)
    letters = [c in "aeiouAEIOU" for c in bare if c.isalpha()]
    mean, spread = SERIAL[name]
    p_serial = normal_below((mean - serial_correlation(letters)) * math.sqrt(max(len(letters), 1)) / spread)
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    half = stat / 2  # chi-squared with 6 degrees of freedom
    joint = math.exp(-half) * (1 + half + half * half / 2)
    # the smaller of the two tells, at twice its value for there being two
    return min(1.0, 2 * min(joint, language_over_uniform(bare, alphabet)))


def _binomial_above(x: int, n: int, rate: float) -> float:
    """P(X >= x), from the mean on by the Chernoff bound."""
    if n <= 0 or x <= n * rate:
        return 1.0
    q = x / n
    divergence = q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0)
    return math.exp(-n * divergence)


def discoveries(runs: list[tuple[int, int, float]], share: float = FALSE_DISCOVERIES) -> list[tuple[int, int]]:
    """Start and end of those runs (start, end, p) that stay under the weighted Benjamini-Hochberg rule."""
    if not runs:
        return []
    mean = sum(b - a for a, b, _ in runs) / len(runs)
    ranked = sorted((p / ((b - a) / mean), a, b) for a, b, p in runs)
    most = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= share * i / len(ranked)), default=0)
    return [(a, b) for _, a, b in ranked[:most]]


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    runs, k, far = [], 0, -1
    for m in CANDIDATE.finditer(text):
        run = m.group()
        # digits alone, or letters of one case alone: numbers and words, where the tests have no power
        if not any(map(str.isalpha, run)) or not any(map(str.isdigit, run)) and (run.lower() == run or run.upper() == run):
            continue
        while k < len(taken) and taken[k][0] < m.end():
            far = max(far, taken[k][2])
            k += 1
        if far > m.start():
            continue
        runs.append((m.start(), m.end(), battery(run)))
    return [(a, 3, b) for a, b in discoveries(runs)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(text: str) -> tuple[int, int, int, int, str, str]:
    base = fixed_spans(text)
    more = random_spans(text, base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*counts, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCANNED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    for batch in batches:
        found = [scan(t.as_py() or "") for t in batch.column(1)]
        columns = list(zip(*found, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the fixed spans, all spans as kind:start:end."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanned, SCANNED)


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id, text with every span replaced by a mark."""

    def work(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py()
                if text is not None:
                    base = fixed_spans(text)
                    parts, at = [], 0
                    for a, _, b in sorted(base + random_spans(text, base)):
                        if b > at:
                            parts += [text[at : max(a, at)], mark]
                            at = b
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(work, mark=mark), "doc_id long, text string")
