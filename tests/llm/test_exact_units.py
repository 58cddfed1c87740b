import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import brute
from cellweave.llm import exact, passages, units
from cellweave.llm.oracles import ORACLES
from cellweave.llm.queries import queries
from oracle import compared


def test_exact_equals_sql(spark):
    left, right = compared(spark, queries()["op1_exact_content_sort"], ORACLES["op1_exact_content_sort"])
    assert left == right


def test_exact_groups(spark, frame):
    rows = [(1, "a"), (5, "a"), (None, "a"), (2, None), (3, ""), (4, "x" * 50_000), (9, "x" * 50_000), (7, "x" * 49_999 + "y"), (6, "dup"), (6, "dup"), (None, "only"), (None, "only")]
    rows += [(100 + i, "hot") for i in range(500)]
    got = exact.content_runs(frame(rows).repartition(7)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for t, ids in by.items():
        mine = [r for r in got if r.sha == brute.sha(t)]
        best = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {best}
        assert sum(r.kept for r in mine) == 1 and next(r for r in mine if r.kept).doc_id == best


def test_runs_over_batches_and_tasks():
    """Any cut of sorted rows into batches gives the same runs."""
    texts = ["a"] * 5 + ["b"] + ["c"] * 7 + ["d"]
    rows = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array(["sha" + t]), pa.array([t])], names=["doc_id", "sha", "text"]) for i, t in enumerate(texts)]
    for seed in range(20):
        rng, batches, at = random.Random(seed), [], 0
        while at < len(rows):
            n = rng.randint(1, 5)
            batches.append(pa.Table.from_batches(rows[at : at + n]).combine_chunks().to_batches()[0])
            at += n
        out = pa.Table.from_batches(list(exact.walk(iter(batches)))).to_pylist()
        assert [r["doc_id"] for r in out] == list(range(14))
        assert [r["run_size"] for r in out] == [5] * 5 + [1] + [7] * 7 + [1]
        assert [r["edge"] for r in out] == [True] * 5 + [False] * 8 + [True]
        assert [r["doc_id"] for r in out if r["last"]] == [4, 5, 12, 13]


def test_exact_empty_and_clashing_columns(spark, frame):
    assert exact.content_runs(frame([])).count() == 0
    wide = frame([(1, "a"), (2, "a")]).select("*", F.lit(1).alias("sha"), F.lit(2).alias("TEXT"), F.lit(3).alias("start"), F.lit(3).alias("h"))
    assert {r.keep_id for r in exact.content_runs(wide).collect()} == {2}


def test_passages_equal_sql(spark):
    left, right = compared(spark, queries()["op4_repeated_units"], ORACLES["op4_repeated_units"])
    assert left == right


LONG = " ".join(f"w{i}" for i in range(60))


def test_units(spark, frame):
    rows = [(3, f"intro\n{LONG}\nend"), (1, f"{LONG.upper()}  \nother"), (2, f"{LONG}\n{LONG}"), (None, LONG), (4, None), (5, ""), (6, "short\nshort"), (7, LONG + "x"), (1, f"{LONG.upper()}  \nother")]
    got = units.repeated_units(frame(rows))
    found = sorted((r.doc_id or -1, r.unit, r.start, r.end, r.n_rows, r.keep_doc_id) for r in got.collect())
    n = len(LONG)
    assert found == sorted([(3, 1, 6, 6 + n, 1, 1), (2, 0, 0, n, 1, 1), (2, 1, n + 1, 2 * n + 1, 1, 1), (-1, 0, 0, n, 1, 1), (1, 0, 0, n + 2, 1, 1)])
    texts = {r.doc_id: r.text for r in units.without_units(frame(rows[:1] + rows[2:3] + rows[6:7])).collect()}
    assert texts == {3: "intro\n\nend", 2: f"{LONG}\n", 6: "short\nshort"}
    assert units.repeated_units(frame([])).count() == 0


def test_paragraphs():
    text = "a b\nc\n\nd\n \n  e"
    assert [text[a:b] for a, b in units.cut_text(text, "paragraph")] == ["a b\nc", "d", "e"]


def test_runs_of_short_lines(spark, frame):
    """A passage in lines of under 50 words goes where it comes again, whatever surrounds it; shorter repeats stay."""
    line = lambda name, n=20: " ".join(f"{name}{i}" for i in range(n))
    passage = "\n".join([line("a"), line("b"), "", line("c"), line("d", 5)])
    short = "\n".join([line("e"), line("f")])
    rows = [(1, f"one\n{passage}\nthen"), (2, f"two two\n{line('a')}\n{passage.upper()}\nelse"), (3, short), (4, f"{short}\nmine"), (5, "\n".join([line("g")] * 9)), (6, None), (7, "")]
    assert units.repeated_units(frame(rows)).count() == 0
    texts = {r.doc_id: r.text for r in units.without_units(frame(rows), "run").collect()}
    assert texts == dict(rows) | {2: f"two two\n{line('a')}\n\nelse", 5: line("g") + "\n"}
    assert units.repeated_units(frame(rows + rows[:1]), "run").filter("doc_id = 1 and n_rows = 1").count() > 0
    assert units.repeated_units(frame([]), "run").count() == 0


def test_shortest_runs_cover_every_run():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 12))]
        whole = set(units.shortest(sizes, 50))
        assert all(sum(sizes[i:j]) >= 50 for i, j in whole)
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes) + 1):
                inside = {k for i, j in whole if a <= i and j <= b for k in range(i, j)}
                assert inside == (set(range(a, b)) if sum(sizes[a:b]) >= 50 else set())


def test_twin_rows_keep_one_unit(spark, frame):
    """Of rows equal in doc_id and text one keeps the unit; another text of that doc_id has spans of its own."""
    rows = [(1, LONG), (1, LONG), (1, f"x\n{LONG}"), (2, LONG)]
    for texts in (units.without_units(frame(rows)), passages.without_passages(frame(rows))):
        assert sorted((r.doc_id, r.text) for r in texts.collect()) == [(1, ""), (1, LONG), (1, "x\n"), (2, "")]


def brute_passages(rows, least):
    """Spans (doc_id, start, end, n_words, keep_doc_id, keep_start) by comparing all windows; doc_ids are distinct."""
    first, spans = {}, []
    for doc, text in sorted(rows):
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        folded = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, _, w in found]
        last = None
        for i in range(len(found) - least + 1):
            keep = first.setdefault(tuple(folded[i : i + least]), (doc, found[i][0]))
            if keep == (doc, found[i][0]):
                continue
            if last is None or i > last + least:
                spans.append({"doc": doc, "start": found[i][0], "word": i, "keep": keep})
            spans[-1] |= {"end": found[i + least - 1][1], "n": i - spans[-1]["word"] + least}
            last = i
    return sorted((s["doc"], s["start"], s["end"], s["n"], *s["keep"]) for s in spans)


def test_passages_equal_brute_force(spark, frame):
    """Passages that begin and end anywhere, overlap, repeat within a text and come in other case and spacing."""
    for seed in range(4):
        rng = random.Random(seed)
        word = lambda n=400: rng.choice("abcdé漢") + str(rng.randrange(n))  # noqa: E731, B023
        passage = [[word() for _ in range(rng.randint(8, 30))] for _ in range(5)]
        rows = []
        for i in range(60):
            parts = []
            for _ in range(rng.randint(0, 4)):
                parts += [word() for _ in range(rng.randint(0, 12))]
                parts += [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choice(passage)]
            if rng.random() < 0.1:
                parts += ["loop", "of", "words"] * 9
            rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in parts)))
        rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, "")]
        got = passages.repeated_passages(frame(rows).repartition(5), least=10).collect()
        assert sorted((r.doc_id, r.start, r.end, r.n_words, r.keep_doc_id, r.keep_start) for r in got) == brute_passages(rows, 10)
        assert {r.n_rows for r in got} == {1}
        texts = {r.doc_id: r for r in passages.without_passages(frame(rows), least=10).collect()}
        assert set(texts) == {i for i, _ in rows} and texts[62].text is None
        for i, text in rows:
            spans = sorted((r.start, r.end) for r in got if r.doc_id == i)
            left, at = "", 0
            for a, b in spans:
                left, at = left + text[at:a], b
            assert [tuple(x) for x in texts[i].removed] == spans and (text is None or texts[i].text == left + text[at:])


def test_planted_passages_are_found(spark, frame):
    """Passages of 51 to 90 words inside lines: all but the first go, documents without any stay as they are."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    planted = [" ".join(word() for _ in range(rng.randint(51, 90))) for _ in range(10)]
    rows = []
    for i in range(200):
        body = [word() for _ in range(rng.randint(20, 300))]
        if i % 2:
            body.insert(rng.randrange(len(body)), planted[i // 2 % 10])
        rows.append((i, " ".join(body)))
    texts = {r.doc_id: r.text for r in passages.without_passages(frame(rows)).collect()}
    for i, text in rows:
        assert texts[i] == (text if i % 2 == 0 or i < 20 else text.replace(planted[i // 2 % 10], ""))
    assert units.repeated_units(frame(rows)).count() == 0


def test_passages_defined_cases(spark, frame):
    assert passages.repeated_passages(frame([])).count() == 0
    assert passages.repeated_passages(frame([(1, None), (2, ""), (3, " ".join("abc")), (4, "a b c"), (4, "a b c")])).count() == 0
    long = " ".join(f"v{i}" for i in range(300_000))
    rows = [(None, LONG), (7, f"head {LONG} tail"), (9, f"{long} {LONG}"), (9, f"{long} {LONG}"), (None, LONG), (8, long)]
    wide = frame(rows).select("*", F.lit(1).alias("key"), F.lit(2).alias("start"), F.lit(3).alias("names"), F.lit(4).alias("DOC_id"), F.lit("x").alias("TEXT"))
    got = sorted((r.doc_id or -1, r.start, r.end, r.n_words, r.n_rows, r.keep_doc_id, r.keep_start) for r in passages.repeated_passages(wide).collect())
    n, m = len(LONG), len(long)
    assert got == sorted([(-1, 0, n, 60, 1, 7, 5), (-1, 0, n, 60, 1, 7, 5), (9, 0, m + 1 + n, 300_060, 1, 8, 0), (9, 0, m + 1 + n, 300_060, 1, 8, 0)])


def test_passages_with_a_hot_text(spark, frame):
    """A third of all rows are one text and another third share one passage."""
    rng = random.Random(3)
    other = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, LONG if i % 3 == 0 else f"{other(5)} {LONG} {other(5)}" if i % 3 == 1 else other(80)) for i in range(3000)]
    got = passages.repeated_passages(frame(rows)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows if i % 3 < 2 and i} and {r.keep_doc_id for r in got} == {0}


def test_names_of_windows():
    """Equal windows have equal names whatever is around them; least_of and rolled equal their plain versions."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 26, 200, 201):
        assert passages.least_of(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
    both = np.concatenate((x[:90], x[10:150]))
    for k in (1, 25, 50):
        found = passages.rolled(both, k, passages.BASES[0])
        assert len(found) == len(both) - k + 1 and len(set(found[:41].tolist())) == 41
        same = 80 - k + 1
        assert found[10 : 10 + same].tolist() == found[90 : 90 + same].tolist()


def test_windows_take_in_repeated_lines(spark):
    """Every line of 50 words and more that repeats an earlier one lies in a span of repeated windows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = [r for r in units.repeated_units(docs, "line", 50).collect()]
    spans = passages.repeated_passages(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert lines
    for x in lines:
        body = texts[x.doc_id][x.start : x.end]
        a, b = x.start + len(body) - len(body.lstrip()), x.start + len(body.rstrip())
        assert any(s.doc_id == x.doc_id and s.start <= a and b <= s.end for s in spans), x
