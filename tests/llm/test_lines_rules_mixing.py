import random

import pytest
from pyspark.sql import functions as F

import brute
from cellweave.llm import linededup, mixing, quality
from cellweave.llm.oracles import ORACLES
from cellweave.llm.queries import queries
from oracle import compared


@pytest.mark.parametrize("name", ["op5_site_lines", "op8_temperature_mix", "op10_quality_rules"])
def test_query_equals_sql(spark, name):
    left, right = compared(spark, queries()[name], ORACLES[name])
    assert left == right


def test_lines_against_brute_force(spark, frame):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "footer", f"line {rng.randint(0, 40)}", "", "  "]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "b"), (500, "menu\nmine", "b")]
    got = linededup.thinned(frame(rows), linededup.Limits(0.2, 3)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.boilerplate_thinned(rows, 0.2, 3)))
    out = linededup.lines_filter(frame(rows), linededup.Limits(0.2, 3))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.filter("n_chars <> length(text)").count() == 0 and out.count() == len(rows)
    assert linededup.lines_filter(frame([])).count() == 0
    wide = frame(rows).select("*", *[F.lit(1).alias(c) for c in ("host", "line", "gone", "row", "TEXT")])
    assert linededup.lines_filter(wide).columns == wide.columns and linededup.lines_filter(wide).count() == len(rows)


def texts():
    rng = random.Random(3)
    made = ["", " \n\t", "one", "a b c a b c", "x " * 300, "\n".join(["same line"] * 5 + ["", " "]), "a\x0bb\x0cc\rd", "é#ü $ % &<>|*", "a b c " * 40 + "d e f", "long" * 5000]
    made += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    made += [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(2000)) for _ in range(3)]
    return made


def test_rule_counts_against_brute_force(spark, frame):
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(texts())] + [(900, None, None), (901, "w " * 9, None), (901, "w " * 9, None)]
    got = quality.rules_report(frame(rows)).collect()
    assert len(got) == len(rows)
    wanted = {i: brute.rule_counts(t) for i, t, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)


def test_repeats_when_hashes_are_cut_or_many(spark, frame, monkeypatch):
    """The path of full hashes gives the same counts as the packed one."""
    rows = [(i, t) for i, t in enumerate(texts())]
    before = {r.doc_id: r.n_repeat_words for r in quality.measured(frame(rows), ["doc_id"]).collect()}
    monkeypatch.setattr(quality.F, "shiftleft", lambda c, n: c * 0)
    after = {r.doc_id: r.n_repeat_words for r in quality.measured(frame(rows), ["doc_id"]).collect()}
    assert after == before


GOOD = " ".join(f"g{i}" for i in range(60))


def test_hosts(spark, frame):
    rows = [(i, GOOD if i % 10 == 0 else "bad", "spam") for i in range(100)] + [(100 + i, GOOD, f"h{i % 5}") for i in range(100)] + [(300, "bad", "tiny")]
    got = {r.doc_id: r for r in quality.rules_report(frame(rows)).collect()}
    assert not got[0].kept and not got[0].base_failed and got[100].kept
    assert {r.doc_id for r in quality.rules_filter(frame(rows)).collect()} == {r.doc_id for r in got.values() if r.kept}
    assert quality.rules_filter(frame(rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert quality.rules_report(frame([])).count() == 0 and quality.rules_filter(frame([])).count() == 0
    wide = frame(rows).select("*", *[F.lit(1).alias(c) for c in ("words", "host", "row", "n", "base_failed", "Text")])
    assert quality.rules_filter(wide).columns == wide.columns


def test_many_hosts_are_joined_by_salt(spark, frame, monkeypatch):
    import cellweave.llm.common as common

    rows = [(i, GOOD if i % 3 else "bad", f"h{i % 7}" if i % 5 else None) for i in range(200)]
    before = sorted(map(tuple, quality.rules_report(frame(rows)).select("doc_id", "kept", "host_rate").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    after = sorted(map(tuple, quality.rules_report(frame(rows)).select("doc_id", "kept", "host_rate").collect()))
    assert [x[:2] for x in before] == [x[:2] for x in after] and [x[2] for x in before] == pytest.approx([x[2] for x in after])


def mixed(spark, frame, rows, mix):
    return mixing.mixture(frame(rows), mix).collect()


def test_mixing_budgets(spark, frame):
    rng = random.Random(1)
    sizes = {"a": 300, "b": 60, "c": 20, None: 10}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * rng.randint(0, 9), s))
            i += 1
    tokens = {i: len(brute.words(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for mix in (mixing.Mix(target_entropy=0.9, max_epochs=100), mixing.Mix(target_entropy=1, max_epochs=2), mixing.Mix(0.8, 3, budget=1000), mixing.Mix(0.99, 100, budget=300)):
        got = mixed(spark, frame, rows, mix)
        table = {r.source: r for r in mixing.weights(frame(rows), mix).collect()}
        assert sum(r.weight for r in table.values()) == pytest.approx(1)
        for s, r in table.items():
            mine = [x for x in got if x.source == s]
            used = sum(tokens[x.doc_id] for x in mine)
            assert used <= r.budget and r.budget - used < 10  # less than one text is left over
            assert r.budget <= mix.max_epochs * r.tokens + 1
            blocks = {}
            for x in mine:
                blocks.setdefault(x.block, []).append(x.doc_id)
            everyone = sorted(i for i in source if source[i] == s)
            for b, ids in blocks.items():
                assert len(ids) == len(set(ids)) and (sorted(ids) == everyone or b == r.epochs)
            # the last block is the beginning of its permutation
            order = sorted(everyone, key=lambda i: next((x.key for x in mine if x.block == r.epochs and x.doc_id == i), 1 << 61))
            assert set(order[: len(blocks.get(r.epochs, []))]) == set(blocks.get(r.epochs, []))
        if mix.budget is None:
            assert {x.doc_id for x in got} == set(source)
    import math

    weights = [r.weight for r in mixing.weights(frame(rows), mixing.Mix(0.9, 100)).collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.9 * math.log(4), abs=1e-6)


def test_mixing_edges(spark, frame):
    assert mixed(spark, frame, [], mixing.Mix()) == []
    got = mixed(spark, frame, [(1, None, "a"), (2, "", "a"), (3, "x", "b"), (3, "x", "b"), (None, "y", "b")], mixing.Mix())
    assert sorted((r.doc_id or -1, r.block) for r in got) == [(-1, 0), (1, 0), (2, 0), (3, 0), (3, 0)]
    one = mixed(spark, frame, [(i, "a b", "s") for i in range(5)], mixing.Mix())
    assert len(one) == 5
    wide = frame([(1, "a", "s")]).select("*", *[F.lit(1).alias(c) for c in ("key", "block", "row", "weight", "SOURCE")])
    assert mixing.mixed_documents(wide).columns == wide.columns


def test_rules_filter_by_shuffle_and_with_copies(spark, frame, monkeypatch):
    """Texts that fail are looked up by hash: broadcast or joined, the same rows go; a null text fails like an empty one."""
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, good if i % 3 else bad, f"h{i % 4}") for i in range(120)] + [(200, None, "h1"), (201, "", "h1"), (None, good, None)]
    rows += [(300 + i, bad if i else good, "failing") for i in range(40)]
    wanted = sorted((r.doc_id or -1) for r in quality.rules_report(frame(rows)).filter("kept").collect())
    assert wanted == sorted([i for i in range(120) if i % 3] + [-1])
    for most in (200_000, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        wide = frame(rows).select("*", F.lit(1).alias("key"), F.lit(2).alias("other"), F.lit(3).alias("row"), F.lit(4).alias("TEXT"))
        kept = quality.rules_filter(wide)
        assert kept.columns == wide.columns and sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == wanted


def test_long_pages_take_time_in_proportion(spark, frame):
    """Pages of thousands of lines that are all boilerplate, kept ones among them."""
    import time

    took = {}
    for n in (4000, 16000):
        text = "\n".join(f"line {i}" if i % 3 else f"  line {i}\t" for i in range(n))
        rows = [(i, text + f"\nown {i}\n\nline 5") for i in range(6)]
        began = time.perf_counter()
        got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.thinned(frame(rows), linededup.Limits(0.5, 3)).collect()}
        took[n] = time.perf_counter() - began
        assert got == {i: (f"own {i}\n", n + 1) for i in range(6)}
    assert took[16000] < 4 * took[4000] + 10
