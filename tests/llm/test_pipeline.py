import math
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from cellweave.llm import mixing

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on the smallest documents, by plain loops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    steps = dict(corpus_pipeline.STAGES)
    frame = docs

    frame = steps["quality_rules"](spark, frame, DATA)
    bad = {i for i, t, _ in rows for n, *_, r in [brute.rule_counts(t)] if n < 50 or 100 * r > 50 * n}
    sources = {s for *_, s in rows}
    rates = {s: [sum(i in bad for i, _, h in rows if h == s), sum(h == s for *_, h in rows)] for s in sources}
    values = [k / n for k, n in rates.values()]
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values) / len(values)
    strength = max(mean * (1 - mean) / spread - 1, 0) if spread else 1e12
    out = {s for s, (k, n) in rates.items() if (k + mean * strength) / (n + strength) > 0.5}
    rows = [r for r in rows if r[0] not in bad and r[2] not in out]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r[0] for r in rows)

    frame = steps["line_dedup"](spark, frame, DATA)
    thin = dict(brute.boilerplate_thinned(rows, 0.01, 5))
    assert {r.doc_id: r.text for r in frame.collect()} == thin

    frame = steps["near_dedup"](spark, frame, DATA)
    found = brute.components(list(thin.items()), 5, 80)
    kept = {i for i, (_, c) in found.items() if i == c}
    assert {r.doc_id for r in frame.collect()} == kept
    assert frame.columns == docs.columns

    frame = steps["mix_sources"](spark, frame, DATA)
    tokens = {i: len(brute.words(thin[i])) for i in kept}
    copies = {}
    for r in frame.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == kept and max(copies.values()) <= 2
    by = {r.source: r for r in mixing.weights(frame.dropDuplicates(["doc_id"])).collect()}
    assert sum(r.weight for r in by.values()) == pytest.approx(1)
    entropy = -sum(r.weight * math.log(r.weight) for r in by.values() if r.weight)
    assert entropy >= 0.99 * math.log(len(by)) - 1e-6 or max(r.budget / r.tokens for r in by.values()) == pytest.approx(2, abs=0.01)
    assert sum(tokens[i] * n for i, n in copies.items()) <= sum(r.budget for r in by.values())

    frame = steps["encode_bpe"](spark, frame, DATA)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: list(r.ids) for r in frame.collect()}
    assert ids == {i: library.encode(thin[i], add_special_tokens=False).ids for i in kept}


def test_run_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.filter("doc_id < 60").withColumn("extra", F.lit(None).cast("int")).write.parquet(f"{tmp_path}/some/documents.parquet")
    batch, folder = spark.conf.get(corpus_pipeline.BATCH), Path(spark.conf.get("spark.checkpoint.dir"))
    there = set(folder.glob("pipeline-*/*"))
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 0
    # only the last stage's table is left, and the session is as it was
    assert [p.name for p in set(folder.glob("pipeline-*/*")) - there] == ["4-encode_bpe"] and spark.conf.get(corpus_pipeline.BATCH) == batch
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and list(corpus_pipeline.queries()) == ["pipeline"]


def test_copies_over_the_line_ratio_leave_one_whole_document(spark, frame):
    """Exact and near copies in more than 1 % of a host's pages come out of near_dedup as one whole text each."""
    steps = dict(corpus_pipeline.STAGES)
    lines = lambda name: [" ".join(f"{name}{k}x{i}" for i in range(40)) for k in range(6)]
    exact, near = lines("e"), lines("n")
    rows = [(i, "\n".join(exact), "s") for i in range(30)]
    rows += [(100 + i, "\n".join([*near[: i % 6], near[i % 6] + f" v{i}", *near[i % 6 + 1 :]]), "s") for i in range(30)]
    own = {200 + i: "\n".join(" ".join(f"o{i}x{k}x{j}" for j in range(30)) for k in range(3)) for i in range(60)}
    rows += [(i, f"{t}\nthe footer of this site", "s") for i, t in own.items()]
    thin = steps["line_dedup"](spark, frame(rows), DATA)
    got = {r.doc_id: r.text for r in steps["near_dedup"](spark, thin, DATA).collect()}
    assert got == {0: rows[0][1], 100: rows[30][1], **own}
