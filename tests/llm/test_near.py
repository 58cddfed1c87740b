import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from cellweave.llm import near
from cellweave.llm.common import cut
from cellweave.llm.components import components, joined_components
from cellweave.llm.oracles import ORACLES
from cellweave.llm.queries import queries
from cellweave.llm.shingles import shingle_sets
from oracle import compared


def test_query_equals_sql(spark):
    left, right = compared(spark, queries()["op9_jaccard_join"], ORACLES["op9_jaccard_join"])
    assert left == right


def corpus(seed, n=150):
    """Texts in groups with a few words changed, passages that many share, and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 60, 120]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in text))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50), (4, 1, 90)])
def test_links_against_brute_force(spark, frame, seed, k, percent):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "One"), (1005, "\x0bone\x0c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.linked(frame(rows).repartition(3), near.Likeness(k, percent)).collect()}
    assert got == brute.components(rows, k, percent)


def test_crowded_count_table(spark, frame, monkeypatch):
    """Every shingle as rare as any other: the order is another, the links are the same."""
    monkeypatch.setattr(near, "rarity", lambda rows, like: np.zeros(1 << 4, np.uint8))
    rows = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.linked(frame(rows), near.Likeness(3, 70)).collect()}
    assert got == brute.components(rows, 3, 70)


@pytest.mark.parametrize("step", [80, 96])
def test_hot_shingles_in_groups(spark, frame, monkeypatch, step):
    """Holders of shingles that the table says are hot are dealt out in groups with hubs of their own; the links are the same."""
    cells = np.zeros(1 << 7, np.uint8)
    cells[::12] = step
    assert near.group_counts(cells)[step] > 1 and near.group_counts(cells)[8] == 0 and not near.group_counts(np.full(64, 250, np.uint8)).any()
    monkeypatch.setattr(near, "rarity", lambda rows, like: cells)
    for k, percent in ((3, 70), (1, 60)):
        rows = corpus(11 + k, 200)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.linked(frame(rows).repartition(3), near.Likeness(k, percent)).collect()}
        assert got == brute.components(rows, k, percent)


def test_sketches_lose_no_link():
    """Whatever links is within reach, also where sets differ in size and a range is full; unrelated sets of some size are not."""
    rng = np.random.default_rng(3)
    ruled_out = 0
    for percent in (50, 80, 85, 100):
        for n in (1, 2, 7, 8, 9, 64, 65, 500, 4000):
            for change in (0, 1, n // 20, n // 8, n // 2, n):
                x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
                y = np.unique(np.concatenate((x[change:], rng.integers(0, 1 << 64, rng.integers(0, change + 1), np.uint64))))
                if not len(y):
                    continue
                both = len(np.intersect1d(x, y))
                near_enough = 100 * both >= percent * (len(x) + len(y) - both)
                found = near.within_reach(near.sketch_of(x), near.sketch_of(y), percent)
                assert found or not near_enough
                ruled_out += not found
    assert ruled_out > 50
    crowd = np.arange(2, 2 * 5000, 2, np.uint64)
    assert max(near.sketch_of(crowd)) == 255
    assert near.within_reach(near.sketch_of(crowd), near.sketch_of(crowd[:4600]), 85)
    texts = [rng.integers(0, 1 << 64, 400, np.uint64) for _ in range(40)]
    sketches = [near.sketch_of(np.unique(t)) for t in texts]
    assert sum(near.within_reach(a, b, 85) for i, a in enumerate(sketches) for b in sketches[:i]) < 40


def test_shingles_of_any_bytes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab AB\t\n\x0b\x0cé日\xa0\x1f") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["x" * 9000, "a " * 5000, ""]
    sets = list(shingle_sets(pa.array(texts), 3))
    plain = [brute.shingles(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    name = {}
    for found, known in zip(sets, plain, strict=True):
        assert name.setdefault(frozenset(known), found.tobytes()) == found.tobytes()
    assert len(set(name.values())) == len(name)


def test_same_hashes_in_any_batch():
    texts = ["alpha beta gamma", "", "delta"] * 10
    whole = [s.tobytes() for s in shingle_sets(pa.array(texts), 2)]
    single = [next(iter(shingle_sets(pa.array([t]), 2))).tobytes() for t in texts]
    sliced = [s.tobytes() for s in shingle_sets(pa.array(["x", *texts]).slice(1), 2)]
    assert whole == single == sliced


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(99, i) for i in range(40)] + [(5, 200), (201, 202)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_of_long_paths_keep_estimates_small(spark):
    """Rounds of joins over checkpoints: Spark's estimate of a size must not double its digits with each of them."""
    rng = random.Random(3)
    names = rng.sample(range(10**6), 600)
    edges = [(names[i], names[i + 1]) for i in range(599) if i % 200 != 199]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert found._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() < 5000
    got = {r.node: r.root for r in found.collect()}
    assert got == {n: min(names[i // 200 * 200 : i // 200 * 200 + 200]) for i, n in enumerate(names)}


def test_cut_in_a_loop_of_joins_keeps_estimates_small(spark):
    rows = cut(spark.createDataFrame([(1, 2), (2, 3), (None, 4)], "x long, y long"))
    for _ in range(14):
        rows = cut(rows.join(rows.select(F.col("x").alias("k")), F.col("x") == F.col("k"), "left").drop("k"))
    assert sorted(rows.collect(), key=str) == sorted([(1, 2), (2, 3), (None, 4)], key=str)
    assert rows.schema.simpleString() == "struct<x:bigint,y:bigint>"
    assert rows._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() <= 512


def test_edges_added_to_components(spark):
    rng = random.Random(5)
    for first, second in (([], [(1, 2)]), ([(1, 2)], []), ([(rng.randrange(40), rng.randrange(40)) for _ in range(15)], [(rng.randrange(60), rng.randrange(60)) for _ in range(20)])):
        frames = [spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long") for edges in (first, second)]
        whole = {r.node: r.root for r in components(frames[0].unionByName(frames[1])).collect()}
        assert {r.node: r.root for r in joined_components(components(frames[0]), frames[1]).collect()} == whole


def test_ids_of_any_kind(spark, frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (3, text + " more"), (8, None), (None, None), (9, "other words altogether here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near.linked(frame(rows)).collect())
    assert got == sorted([(-1, 3), (7, 3), (7, 3), (3, 3), (8, 8), (-1, -1), (9, 9)])
    kept = near.one_of_each(frame(rows))
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(3, text + " more"), (8, ""), (-1, ""), (9, "other words altogether here")])
    twins = [(5, text), (5, text), (5, "totally different words in this row"), (None, "lonely null words"), (None, "lonely null words")]
    assert sorted((r.doc_id or -1, r.text) for r in near.one_of_each(frame(twins)).collect()) == sorted({(i or -1, t) for i, t in twins})


def test_empty_and_clashing_columns(spark, frame):
    assert near.linked(frame([])).count() == 0 and near.one_of_each(frame([])).count() == 0
    wide = frame([(1, "a b c d e f"), (2, "a b c d e f")]).select("*", *[F.lit(1).alias(c) for c in ("node", "token", "row", "its_id", "TEXT")])
    assert near.one_of_each(wide).columns == wide.columns and near.one_of_each(wide).count() == 1


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_long_texts_part_by_part(k, size):
    from cellweave.llm.shingles import long_set

    rng = random.Random(k)
    for text in ("", " ", "one", "a b", "  a  b\tc ", "x" * 300, " ".join(rng.choice(["a", "bb", "Ccc", "d" * 90]) for _ in range(400)) + " \n"):
        whole = next(shingle_sets(pa.array([text]), k))
        assert (long_set(np.frombuffer(text.encode(), np.uint8), k, size) == whole).all(), text[:40]


def test_memory_of_a_long_text():
    """64 MB of text take well under 1 GB."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import resource, pyarrow as pa; from cellweave.llm.shingles import shingle_sets; text = pa.array([' '.join(str(i * 7919 % 1000003) for i in range(9_500_000))]); n = len(next(shingle_sets(text, 5))); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    n, megabytes = map(int, done.stdout.split())
    assert n > 900_000 and megabytes < 1500
