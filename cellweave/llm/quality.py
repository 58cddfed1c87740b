"""Quality rules with host verdicts, DataFrame functions only.

A text fails by rules of its own (too short, too many repeated words); the failures of a host are
counted, the host's failure rate is shrunk towards the mean of all hosts with a beta prior fitted
by moments, and hosts whose shrunk rate is above a limit take their documents with them.

Defined cases: a null text counts as empty, so it fails as too short; a null host is a host of its
own; repeated rows count and come out once each; an empty table gives an empty table; columns other
than the three that are read pass through rules_filter untouched and are ignored by rules_report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, cut, join_groups, packed, pick, split_words, unpacked

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_host_rate: float = 0.5


def measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column text.

    Three-word windows are compared by 64-bit hashes: equal counts of windows and of distinct hashes
    clear a text at once; else each hash is packed with its position into one long and sorted,
    unless cutting the hash to 44 bits merged windows (or there are 2**20 words), when pairs of
    128-bit hash and position are sorted instead.
    """
    mask = F.lit((1 << 20) - 1).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.select(*keep, text.alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    df = df.select(
        *keep,
        split_words(F.col("body")).alias("words"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.select(
        *keep,
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    count = F.greatest(F.size("codes") - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("codes", i + 1, count).alias(n) for i, n in enumerate("abc")])
    df = df.select(*base, "words", F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("seen"))
    short = F.transform("seen", lambda x: F.shiftleft(x, 20))
    df = df.select(*base, "words", "seen", F.size("seen").alias("n"), F.size(F.array_distinct("seen")).alias("kinds"), F.size(F.array_distinct(short)).alias("short_kinds"))
    fast = F.sort_array(F.transform("seen", lambda x, i: F.shiftleft(x, 20).bitwiseOR(i.cast("long"))))
    wide = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words") - 2, F.lit(0))).alias(n) for i, n in enumerate("abc")])
    sure = F.sort_array(F.transform(wide, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), F.xxhash64(x["c"], F.lit(1), x["b"], x["a"]).alias("g"), i.cast("long").alias("i"))))
    repeated = F.col("kinds") < F.col("n")
    packs = repeated & (F.col("short_kinds") == F.col("kinds")) & (F.col("n") < (1 << 20))
    df = df.select(*base, F.when(packs, fast).alias("fast"), F.when(repeated & ~packs, sure).alias("sure"))

    def following(name: str) -> tuple[Column, Column]:
        return F.slice(name, 1, F.size(name) - 1), F.slice(name, 2, F.size(name) - 1)

    none = F.lit(None).cast("array<long>")
    near = F.zip_with(*following("fast"), lambda x, y: F.when(F.shiftright(x, 20) == F.shiftright(y, 20), F.array(x.bitwiseAND(mask), y.bitwiseAND(mask))).otherwise(none))
    same = F.zip_with(*following("sure"), lambda x, y: F.when((x["h"] == y["h"]) & (x["g"] == y["g"]), F.array(x["i"], y["i"])).otherwise(none))
    pairs = F.when(F.col("fast").isNotNull(), near).when(F.col("sure").isNotNull(), same)
    starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return df.select(*base, F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words")).withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)).cast("long"))


def fails(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)


def host_verdicts(flags: DataFrame, rules: Rules) -> DataFrame:
    """Rows host, failed, docs, host_rate, host_failed of rows host, base_failed.

    The beta prior has the mean and the variance of the hosts' rates; without any variance every
    host gets the mean, and where the variance is that of a coin (or there is one host) none is used.
    """
    hosts = flags.groupBy("host").agg(F.count_if("base_failed").alias("failed"), F.count(F.lit(1)).alias("docs"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    strength = F.when(F.col("spread") <= 0, F.lit(1e12)).otherwise(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1, F.lit(0.0)))
    prior = prior.select("mean", strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    scored = hosts.join(F.broadcast(prior))  # one row
    return scored.select("host", "failed", "docs", shrunk.alias("host_rate"), (shrunk > rules.max_host_rate).alias("host_failed"))


def rules_report(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, its host's shrunk rate, kept."""
    rows = pick(docs, "doc_id", "text", host).withColumnRenamed(host, "host")
    rows = cut(measured(rows, ["doc_id", "host"]).withColumn("base_failed", fails(rules)))
    verdicts = cut(host_verdicts(rows.select("host", "base_failed"), rules).select("host", "host_rate", "host_failed"))
    joined = join_groups(rows, verdicts, "host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def rules_filter(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns.

    A text is counted once: whether it fails depends on nothing else, so the texts that fail are looked up by a 128-bit hash.
    A few are broadcast, many joined by plain shuffles, which adaptive execution splits where a text has many copies.
    """
    rows = pick(docs, "text", host).withColumnRenamed(host, "host")
    flags = measured(_hashed(rows), ["host", *HASHES]).select("host", *HASHES, fails(rules).alias("base_failed"))
    flags = cut(flags)
    verdicts = cut(host_verdicts(flags.select("host", "base_failed"), rules).select("host", "host_failed"))
    failed = cut(flags.filter("base_failed").select(F.col("key").alias("its_key"), F.col("other").alias("its_other")).distinct())
    if failed.count() <= BROADCAST_ROWS:
        failed = F.broadcast(failed)
    whole = _hashed(packed(docs, "text", host).withColumnRenamed(host, "host"))
    good = whole.join(failed, (whole["key"] == failed["its_key"]) & (whole["other"] == failed["its_other"]), "left_anti")
    good = join_groups(good.select("row", "host"), verdicts, "host").filter(~F.col("host_failed"))
    return unpacked(good, docs.columns)


HASHES = ("key", "other")


def _hashed(df: DataFrame) -> DataFrame:
    """df with 128 bits of hash of column text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumns({"key": F.xxhash64(text), "other": F.xxhash64(F.lit(1), text)})
