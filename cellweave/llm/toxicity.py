"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case; letters that look like Latin ones; digits and signs that stand for letters, beside letters
only; all that is no letter becomes one space. The lexicon has whole words and beginnings of words with their
weights (log odds of the labels); matches inside an exception phrase don't count. The score is a
logistic function of the sums of the strong and the weak weights, the latter also divided by the number of words and
by its square root.

Weights and function are learned from labelled rows of the training folds: at most SAMPLE of each label, those
with the smallest hashes of doc_id; everything else covers all rows.

Defined cases: null and empty texts are scored like texts without matches; without training rows of both labels
every score is 0; of several labels of a doc_id the largest counts; a null doc_id is held out; repeated rows come out as
often; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: Labelled rows of each label that the lexicon and the function are fitted on, at most.
SAMPLE = 4000
#: Terms that are weighed at most, and how often a term must be in toxic texts of the sample.
TERMS, LEAST = 4000, 5
FOLDS = 5
#: Weights from here on tell on their own; smaller ones by how many there are.
STRONG = 5.5
#: Lengths of beginnings of words.
SHORTEST, LONGEST = 4, 10

#: Cyrillic and Greek letters and the Latin ones they look like.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝқαεικνορτυχ", "aeopcyxijshdqwkaeikvoptux", strict=True))
#: Digits and signs and the letters they stand for.
DIGITS = dict(zip("0134578@$!", "oieastbasi", strict=True))
#: Phrases in which a term does no harm.
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish", "kill time", "dumb bell")

_FOLD = str.maketrans(HOMOGLYPHS)
_STANDS = re.compile(r"[0134578@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![^\W_])")
_LETTERS = str.maketrans(DIGITS)
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Words of letters with one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _STANDS.sub(lambda m: m[0].translate(_LETTERS), text)
    return f" {_OTHER.sub(' ', text).strip()} "


def terms(text: str) -> list[str]:
    """Distinct words (between spaces) and beginnings of words (after a space) of a text."""
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return list(out)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matches(self, text: str) -> tuple[int, list[float]]:
        """Number of words, weights of the matches."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(folded(phrase), (len(folded(phrase)), 0.0))
            self._automaton.make_automaton()
        body = folded(text)
        n = body.count(" ") - 1 if body.strip() else 0
        if not len(self._automaton):
            return n, []
        hits = sorted((end - size + 1, -end, weight) for end, (size, weight) in self._automaton.iter(body))
        # by where they begin, of those the longest first: a match lies in a phrase if one that begins no later reaches its end
        found, reach = [], -1
        for _, end, weight in hits:
            if weight == 0.0:
                reach = max(reach, -end)
            elif -end > reach:
                found.append(weight)
        return n, found

    def features(self, text: str) -> list[float]:
        n, found = self.matches(text)
        high = sum(w for w in found if w >= STRONG)
        low = sum(found) - high
        return [1.0, min(high, 20.0), np.log1p(high), np.log1p(low), low / np.sqrt(n + 1.0), min(100 * low / (n + 1), 30.0), np.log1p(n)]

    def score(self, text: str) -> float:
        if not self.coefficients:
            return 0.0
        z = float(np.dot(self.features(text), self.coefficients))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text, weight (rows of the label that each stands for)."""
    known = pick(labels, "doc_id", "toxic").filter("toxic is not null").filter(fold_of(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    parts = [known.filter(F.col("toxic") == k).orderBy(order).limit(SAMPLE).withColumn("weight", F.lit(max(1.0, sizes.get(k, 0) / SAMPLE))) for k in (0, 1)]
    some = cut(parts[0].unionByName(parts[1]))  # 2 * SAMPLE rows of a few bytes
    rows = pick(docs, "doc_id", "text").filter("doc_id is not null")
    return rows.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "weight", "text")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([terms(t.as_py() or "") for t in part.column(3)], pa.list_(pa.string()))], names=["toxic", "terms"])


def weigh(sample: DataFrame) -> tuple[dict[str, float], tuple[str, ...]]:
    """Weights of the terms, and words that begin like a toxic term but aren't."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, ()
    each = sample.mapInArrow(_terms, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    counts = counts.filter((F.col("a") + F.col("b")) >= 3)
    a, b, p = F.col("a"), F.col("b"), toxic / (toxic + clean)
    n = a + b
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    gain = 2 * (F.when(a > 0, a * F.log(a / (n * p))).otherwise(0) + F.when(b > 0, b * F.log(b / (n * (1 - p)))).otherwise(0))
    counts = cut(counts.withColumn("odds", odds).withColumn("gain", gain))
    best = counts.filter((a >= LEAST) & (F.col("odds") >= 1.5) & (F.col("gain") >= 20)).orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(TERMS).select("term", "odds").collect()
    chosen: dict[str, float] = {}
    for row in best:
        term = row["term"]
        bare = term.rstrip()
        # one of a word and its beginnings is enough: the one that tells most
        if any(term.startswith(t.rstrip()) or t.startswith(bare) for t in chosen):
            continue
        chosen[term] = float(row["odds"])
    starts = [t for t in chosen if not t.endswith(" ")]
    begins = F.lit(False)
    for size in sorted({len(t) for t in starts}):
        begins |= F.substring("term", 1, size).isin([t for t in starts if len(t) == size])
    harmless = counts.filter(F.col("term").endswith(" ") & begins & (b >= 3) & (F.col("odds") <= 0)).orderBy(F.desc("b"), "term").limit(TERMS).select("term").collect()
    return chosen, tuple(r["term"].strip() for r in harmless)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method on scaled features."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = x / scale
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        gradient = z.T @ (w * (p - y)) + ridge * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta / scale


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lexicon.features(t.as_py() or "") for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "weight", "x"])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    sample = cut(training_sample(docs, labels).withColumn("toxic", F.col("toxic").cast("int")).select("doc_id", "toxic", "weight", "text"))
    weights, harmless = weigh(sample)
    if not weights:
        return Lexicon()
    lexicon = Lexicon(weights, (*EXCEPTIONS, *harmless))
    rows = sample.mapInArrow(partial(_features, lexicon=lexicon), "toxic int, weight double, x array<double>").collect()  # 2 * SAMPLE rows
    beta = fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["weight"] for r in rows]))
    return Lexicon(weights, lexicon.exceptions, tuple(beta))


def _scores(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([lexicon.score(t.as_py() or "") for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "text")
    scored = rows.mapInArrow(partial(_scores, lexicon=lexicon), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
