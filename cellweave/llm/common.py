"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import removed, shared_folder

#: The six white space characters of the contracts, as a character set for translate and trim.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the exact name first, then the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    lowered = [c.lower() for c in df.columns]
    if name.lower() in lowered:
        return lowered.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names _0, _1, ...: clashing names do no harm."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the frame holds."""
    plain = numbered(df)
    return plain.select(*[plain[f"_{position(df, n)}"].alias(n) for n in names])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """Column row (a struct of all columns, by number) and the named columns beside it."""
    plain = numbered(df)
    whole = F.struct(*[plain[c] for c in plain.columns]).alias("row")
    return plain.select(whole, *[plain[f"_{position(df, n)}"].alias(n) for n in names])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """Undo packed(): the columns of the original frame, those in new replaced."""
    found = [new.get(c, F.col(f"row._{i}")).alias(f"_{i}") for i, c in enumerate(columns)]
    return df.select(*found).toDF(*columns)


#: For the time of a checkpoint: its shuffle files go when it is over, and workers get rows in small batches.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: Rows that a part of a checkpoint has at least, about, where their number is known: fewer parts, fewer tasks and files.
PART_ROWS = 50_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write the rows to the shared checkpoint folder and forget how they were made.

    The shuffle files behind them go at once: nothing reads them again. rows: how many there are at most, if that is known.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    with _settings(spark):
        return _plainly_estimated(df.select("*").checkpoint(eager=True))  # select: a plan made under the settings


#: Bits of an estimated size in bytes above which it tells nothing: no table has so many.
ESTIMATE_BITS = 512


def _plainly_estimated(written: DataFrame) -> DataFrame:
    """The written rows, without Spark's estimate of their size if that is absurd.

    A checkpoint keeps the estimate of the plan behind it, and a join's is the product of its sides': in a loop of joins each
    doubles the digits, until the driver's time and heap go to multiplying numbers of megabytes.
    """
    plan = written._jdf.queryExecution().analyzed()
    with contextlib.suppress(ValueError):  # Python reads no number of over 4,300 digits
        if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
            return written
    spark = written.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), written._jdf.schema(), False), spark)


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextlib.contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table in the shared folder, which is deleted when the block ends: for what is large and soon of no use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    with _settings(spark):
        df.select("*").write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)


def split_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text without null; an empty array if there is none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


#: A table of so many rows at most (one a source or host) may be broadcast; larger ones are joined by key and salt.
BROADCAST_ROWS = 200_000
SALTS = 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of groups (cut, one row a key, null a key like others), left join.

    Groups are counted first: a few are broadcast, many are copied SALTS times and joined by key and
    salt, so that the rows of one large group go to many tasks.
    """
    renamed = groups.withColumnRenamed(key, "its_key")
    if renamed.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(renamed), rows[key].eqNullSafe(renamed["its_key"]), "left").drop("its_key")
    dealt = rows.withColumn("its_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = renamed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    matched = dealt[key].eqNullSafe(copies["its_key"]) & (dealt["its_salt"] == copies["part"])
    return dealt.join(copies, matched, "left").drop("its_key", "its_salt", "part")


def text_key(text: Column) -> Column:
    """Name of a text: with doc_id beside it, what tells rows apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def remaining(text: Column, removed: Column) -> Column:
    """A text without sorted spans, which may overlap."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    piece = lambda begin, end: F.substring(text, begin.cast("int") + 1, (end - begin).cast("int"))
    step = lambda s, x: F.struct(F.concat(s["parts"], F.array(piece(s["at"], F.greatest(x["start"], s["at"])))).alias("parts"), F.greatest(x["end"], s["at"]).alias("at"))
    return F.aggregate(removed, empty, step, lambda s: F.array_join(F.concat(s["parts"], F.array(piece(s["at"], F.length(text).cast("long")))), ""))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, text without the spans that it loses, removed: these spans {start, end}; a row for every row.

    gone: key (of the text), doc_id, start, end, twin. Spans with twin are lost by all but one of the rows equal in doc_id and text.
    """
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    lists = gone.groupBy(F.col("key").alias("its_key"), F.col("doc_id").alias("its_id")).agg(
        F.array_sort(F.collect_set(span)).alias("all"),
        F.array_sort(F.collect_set(F.when(~F.col("twin"), span))).alias("ones"),
        F.max("twin").alias("twins"),
    )
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("key", text_key(F.col("text")))
    both = texts.join(lists, (texts["key"] == lists["its_key"]) & texts["doc_id"].eqNullSafe(lists["its_id"]), "left")
    # rows are numbered among twins only
    k = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy(F.lit(1)))
    single = both.filter("twins is null or not twins").withColumn("removed", F.coalesce("all", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    twins = both.filter("twins").withColumn("k", k).withColumn("removed", F.when(F.col("k") == 1, F.col("ones")).otherwise(F.col("all"))).drop("k")
    return single.unionByName(twins).select("doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(remaining(F.col("text"), F.col("removed"))).alias("text"), "removed")
