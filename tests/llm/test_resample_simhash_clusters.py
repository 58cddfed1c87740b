"""op11, op12 and op13 against SQL and against plain versions written apart from them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from cellweave.llm import clusters, importance, simhash
from cellweave.llm.common import cut
from cellweave.llm.oracles import ORACLES
from cellweave.llm.queries import queries
from cellweave.llm.tokens import plain_words, runs, spaced_words
from oracle import compared


@pytest.mark.parametrize("name", ["op11_importance_resample", "op13_block_clusters"])
def test_query_equals_sql(spark, name):
    left, right = compared(spark, queries()[name], ORACLES[name])
    assert left == right


# words


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 20])
def test_words_in_pieces(size):
    text = "Ab  cÉd e\t\x0bF-g\nlongerword h " + "中文 x1Y2 " * 5
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    raw = memoryview(text.encode())
    got = [w.decode() for p in spaced_words(raw, size) for w in p]
    assert got == re.findall(r"[^\x20\x09-\x0D]+", lower)
    plain = [w.decode() for p in plain_words(raw, size) for w in p]
    assert plain == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    for n in (1, 2, 3):
        wanted = Counter(" ".join(plain[i : i + k]) for k in range(1, n + 1) for i in range(len(plain) - k + 1))
        assert Counter(f.decode() for fs in runs(plain_words(raw, size), 1, n) for f in fs) == wanted


# importance resampling


def resampled_plainly(rows, target, draw):
    def features(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return [" ".join(w[i : i + k]) for k in range(1, draw.n + 1) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % draw.buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + draw.buckets) / ((s[b] + 1.0) * (t.total() + draw.buckets))))
    out = []
    for i, text in rows:
        found, n_words = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((r for r in out if r[4] >= draw.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: draw.percent * len(fit) // 100])}
    return sorted((*r[:4], drawn.get(id(r))) for r in out if r[0] is not None), [(*r[:4], drawn.get(id(r))) for r in out if r[0] is None]


def prose(seed, n):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(20)], [f"Rare{i}é" for i in range(400)]
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("n", "frequent", "piece"), [(1, 50_000, 1 << 20), (1, 8, 1 << 20), (2, 30, 64), (3, 0, 64)])
def test_resampling_against_brute_force(spark, frame, monkeypatch, n, frequent, piece):
    monkeypatch.setattr(importance, "ROWS", 50)
    monkeypatch.setattr(importance, "plain_words", lambda raw: plain_words(raw, piece))
    draw = importance.Draw(n=n, buckets=97, percent=30, least_words=10, seed="7")
    rows = [*prose(n, 120), (500, None), (501, ""), (502, " -- \n"), (503, "Single"), (504, "w1 " * 3000)]
    target = [t for _, t in prose(99, 10)] + [None]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resampled(frame(rows).repartition(5), goal, draw, frequent)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == resampled_plainly(rows, target, draw)[0]


def test_resampling_of_repeated_rows_and_null_ids(spark, frame):
    draw = importance.Draw(buckets=11, percent=100, least_words=1)
    rows = [(1, "a b c d")] * 3 + [(1, "a b"), (None, "a b c"), (None, "a b c"), (2, "a b")]
    found = importance.resampled(frame(rows).select("text", F.lit(1).alias("TEXT"), "doc_id", F.lit(2).alias("weight")), frame([]), draw).collect()
    assert Counter((r.doc_id, r.n_features) for r in found) == {(1, 4): 3, (1, 2): 1, (None, 3): 2, (2, 2): 1}
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5, 6, 7]
    assert importance.resampled(frame([]), frame(rows), draw).collect() == []


# SimHash


def print_plainly(text, k):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in brute.words(text)]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_plainly(prints, radius):
    root = dict.fromkeys(prints)
    root = {p: p for p in root}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(list(root), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_fingerprints_match_sparks_hash(spark, frame):
    texts = ["one Two three", "one", "ONE two", "a b c d e f g h É", None, "", " \t", "x y z\x0bx y z", "w " * 5000]
    got = {r.doc_id: r.print % (1 << 64) for r in simhash.fingerprints(frame(list(enumerate(texts))), 3).collect()}
    assert got == {i: print_plainly(t, 3) for i, t in enumerate(texts)}
    jvm = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert jvm % (1 << 64) == got[0]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_fingerprint_in_pieces(monkeypatch, size):
    monkeypatch.setattr(simhash, "spaced_words", lambda raw: spaced_words(raw, size))
    for text in ("alpha beta gamma delta alpha beta gamma", "alpha beta", "alpha", ""):
        assert simhash.fingerprint(memoryview(text.encode()), 3) == print_plainly(text, 3)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_difference_within_the_radius_shares_a_bucket(radius):
    rng = random.Random(radius)
    level = simhash.Level(list(simhash.masks((1 << 64) - 1, radius)), radius)
    while True:
        width = (1 << radius + 1) - 1
        for _ in range(3000):
            parent = rng.randrange(len(level.compared) // width)
            tables = level.compared[parent * width : (parent + 1) * width]
            shared = ~0
            for c in tables:
                shared &= c
            free = [b for b in range(64) if not shared >> b & 1]
            apart = sum(1 << b for b in rng.sample(free, radius))
            # bits outside of what the level before ignores are equal already
            if any(all(c >> b & 1 for c in tables) and apart >> b & 1 for b in range(64)):
                continue
            assert any(not apart & c for c in tables)
        if level.last():
            break
        level = level.next()


@pytest.mark.parametrize(("direct", "radius"), [(2, 3), (8, 3), (64, 3), (4, 2), (3, 1)])
def test_links_of_dense_and_sparse_prints(spark, direct, radius):
    """Balls of near fingerprints, chains, and many that share most bits without a link."""
    rng = random.Random(direct)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    base = rng.getrandbits(64)
    prints |= {base ^ sum(1 << b for b in range(k)) for k in range(0, 64, 3)}
    block = rng.getrandbits(34) << 30
    prints |= {block | rng.getrandbits(30) for _ in range(300)}
    frame = cut(spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long"))
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.prints_roots(frame, radius, direct).collect()}
    wanted = linked_plainly(prints, radius)
    groups = lambda of: sorted(sorted(p for p in prints if of(p) == r) for r in {of(p) for p in prints})
    assert groups(lambda p: roots.get(p, p)) == groups(wanted.get)


def test_near_copies_query(spark, frame):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(400)] = "changed"
        rows.append((i + 10, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " "), (None, " "), (4, "some other text"), (4, "some other text"), (5, "Some OTHER text")]
    found = simhash.near_copies(frame(rows).select("text", "doc_id", F.lit(1).alias("print"), F.lit("x").alias("Text"))).collect()
    prints = {i: print_plainly(t, 3) for i, t in enumerate(t for _, t in rows)}
    root = linked_plainly(prints.values(), 3)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root[prints[i]]
        least[r] = min(x for x in (least.get(r), doc) if x is not None) if least.get(r) is not None or doc is not None else None
    wanted = Counter((doc, f"{prints[i]:016x}", least[root[prints[i]]]) for i, (doc, _) in enumerate(rows))
    assert Counter(map(tuple, found)) == wanted
    assert simhash.near_copies(frame([])).collect() == []


def test_query_over_the_smallest_tables(spark):
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    prints = {i: print_plainly(t, 3) for i, t in rows}
    root, least = linked_plainly(prints.values(), 3), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    found = queries()["op12_simhash_covering"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found)) == sorted((i, f"{p:016x}", least[root[p]]) for i, p in prints.items())


# clusters


def clustered_plainly(rows, plan):
    kept = [(i, [math.floor(plan.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == plan.length and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"{plan.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(kept, key=name)[: plan.clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(plan.rounds + 1):
        at = [min((dist(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids)) if k < plan.rounds else ():
            mine = [v for (_, v), (_, x) in zip(kept, at, strict=True) if x == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i if i is not None else -1), j, d, inertia[j], inertia.total(), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True))


@pytest.mark.parametrize(("seed", "plan"), [(1, clusters.Plan()), (2, clusters.Plan(length=5, clusters=4, rounds=3, segment=2)), (3, clusters.Plan(length=3, clusters=20, rounds=6, scale=3, segment=8)), (4, clusters.Plan(length=7, clusters=1, rounds=0))])
def test_clusters_against_brute_force(spark, monkeypatch, seed, plan):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(plan.length)] for _ in range(5)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.4))) for m in rng.choice(middles)]) for i in range(90)]
    rows += [(200, None), (201, []), (202, [0.5] * (plan.length + 1)), (203, [None] * plan.length), (204, [float("nan")] * plan.length), (205, [float("inf")] + [0.0] * (plan.length - 1)), (206, [float("-inf")] * plan.length)]
    rows += [(300, [0.25] * plan.length)] * 30 + [(None, [0.5] * plan.length), (301, [-0.25] * plan.length), (301, [0.75] * plan.length)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    frame = frame.select(F.lit(3).alias("cluster"), F.lit("x").alias("EMBEDDING"), "vec_id", "embedding")
    got = sorted(((r.vec_id if r.vec_id is not None else -1), *tuple(r)[1:]) for r in clusters.clustered(frame, plan).collect())
    assert got == clustered_plainly(rows, plan)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    plan = clusters.Plan(length=2, clusters=8)
    rows = [(1, [1.0, 2.0]), (2, [1e300, -1e300])]
    found = {r.vec_id: r for r in clusters.clustered(spark.createDataFrame(rows, schema), plan).collect()}
    assert {r.distance for r in found.values()} == {0} and len({r.cluster for r in found.values()}) == 2
    assert clusters.clustered(spark.createDataFrame([], schema), plan).collect() == []


def test_bounds_never_rule_out_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, clusters.LARGEST):
        vectors = rng.integers(-scale, scale, (500, 64))
        centroids = np.concatenate([vectors[:6], vectors[:2]])
        short = clusters.compressed(vectors, 8)
        at, best, exact = clusters.nearest(vectors, short, centroids, 8)
        all_ = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (at == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all() and exact <= len(vectors) * len(centroids)


def test_very_long_texts(spark, frame, monkeypatch):
    """Texts of some MB, and a word of some MB, are taken in pieces and come to the same."""
    long = " ".join(str(i * 7919 % 5003) for i in range(500_000))
    word = "x" * 3_000_000
    pieces = simhash.fingerprint(memoryview(long.encode()), 3)
    with monkeypatch.context() as m:
        m.setattr(simhash, "spaced_words", lambda raw: spaced_words(raw, 1 << 30))
        assert simhash.fingerprint(memoryview(long.encode()), 3) == pieces
    rows = [(1, long), (2, word), (3, long), (4, f"{word} {word} a")]
    found = {r.doc_id: r for r in simhash.near_copies(frame(rows)).collect()}
    assert found[1].fingerprint == found[3].fingerprint == f"{pieces:016x}" and found[3].component_id == 1
    assert found[2].fingerprint == f"{xxhash.xxh64_intdigest(word, 42):016x}"
    got = {r.doc_id: r for r in importance.resampled(frame(rows), frame([(0, long)]), importance.Draw(percent=50)).collect()}
    assert {i: r.n_features for i, r in got.items()} == {1: 500_000, 2: 1, 3: 500_000, 4: 3}
    assert got[1].weight == got[3].weight and sorted(r["rank"] for r in got.values() if r["rank"]) == [1]


def test_ties_go_to_the_smaller_id(spark, frame, monkeypatch):
    """Equal scores: of all documents the first by number are drawn."""
    monkeypatch.setattr(importance, "weights", lambda docs, target, draw, frequent: docs.select("doc_id", F.lit(1).cast("long").alias("key"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight")))
    rows = [(i, "a") for i in range(200)]
    draw = importance.Draw(percent=10)
    scored = sorted(((r.doc_id, r.score, r["rank"]) for r in importance.resampled(frame(rows).repartition(7), frame([]), draw).collect()), key=lambda r: (-r[1], r[0]))
    assert [r[2] for r in scored] == [*range(1, 21), *[None] * 180]
