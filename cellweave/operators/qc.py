"""Quality logs of other tools as rows (sample, class, metric, value), and tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that name a row, not a metric; names of the nine numbers of a count file, line by line.
NOT_METRICS = ("SAMPLE", "LIBRARY", "READ_GROUP", "CATEGORY")
RSEM_METRICS = (("unalignable reads", "alignable reads", "filtered reads", "total reads"), ("unique aligned", "multiple mapped", "uncertain reads"), ("total alignments", "strand"))


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name (of the file), text."""
    return spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def sample_of(name: Column, mark: str = "_qc") -> Column:
    return F.split_part(name, F.lit(mark), F.lit(1))


def picard_rows(files: DataFrame) -> DataFrame:
    """sample, file, class, row (from 0), column (from 0), key, value of the metrics section."""
    section = F.regexp_extract("text", r"(?s)## METRICS CLASS\t([^\n]*)\n(.*?)(?:\n\n|\n## |\z)", 2)
    named = files.select("name", F.element_at(F.split(F.regexp_extract("text", r"## METRICS CLASS\t([^\n]*)", 1), r"\."), -1).alias("class"), F.split(F.rtrim(section), "\n").alias("lines"))
    rows = named.select("name", "class", F.split(F.col("lines")[0], "\t").alias("keys"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line")).filter("line <> ''")
    cells = rows.select("name", "class", "row", F.posexplode(F.arrays_zip("keys", F.split("line", "\t").alias("values"))).alias("column", "cell"))
    return cells.select(sample_of(F.col("name")).alias("sample"), F.col("name").alias("file"), "class", "row", "column", F.col("cell.keys").alias("key"), F.nullif(F.col("cell.values"), F.lit("")).alias("value"))


def picard_metrics(files: DataFrame) -> DataFrame:
    """Long rows: alignment summaries as METRIC.CATEGORY for every category, all else the first row."""
    cells = picard_rows(files)
    by_category = F.col("class") == "AlignmentSummaryMetrics"
    categories = cells.filter(by_category & (F.col("key") == "CATEGORY")).select(F.col("file").alias("its"), F.col("row").alias("its_row"), F.col("value").alias("category"))
    kept = cells.filter(~F.col("key").isin(list(NOT_METRICS)) & (by_category | (F.col("row") == 0)))
    joined = kept.join(categories, (kept["file"] == categories["its"]) & (kept["row"] == categories["its_row"]), "left")
    return joined.select("sample", "class", F.when(by_category, F.concat_ws(".", "key", "category")).otherwise(F.col("key")).alias("metric"), "value")


def picard_table(files: DataFrame) -> DataFrame:
    """One row per line of the metrics section, Sample first: for files of one class."""
    cells = picard_rows(files)
    keys = [r["key"] for r in cells.filter("row = 0").groupBy("key").agg(F.min("column").alias("c")).orderBy("c").collect()]  # a header's names
    # a key may be sample in capitals
    wide = cells.withColumn("key", F.concat(F.lit("its "), "key")).groupBy("sample", "file", "row").pivot("key", [f"its {k}" for k in keys]).agg(F.first("value"))
    return wide.orderBy("file", "row").select(F.col("sample").alias("Sample"), *[F.col(f"`its {k}`").alias(k) for k in keys])


def hisat2_metrics(files: DataFrame) -> DataFrame:
    """Long rows of alignment summaries: the genome's (file name with _qc) or the transcriptome's (_rsem)."""
    mark = F.when(F.col("name").contains("_qc"), "_qc").when(F.col("name").contains("_rsem"), "_rsem")
    kind = F.when(mark == "_qc", "HISAT2G").when(mark == "_rsem", "HISAT2T").otherwise("NONE")
    lines = files.select(F.split_part("name", mark, F.lit(1)).alias("sample"), kind.alias("class"), F.posexplode(F.split("text", "\n")).alias("k", "line")).filter("k > 0 and trim(line) <> ''")
    return lines.select("sample", "class", F.trim(F.regexp_extract("line", r"^\s*([^:]*):", 1)).alias("metric"), F.regexp_extract("line", r":\s*(\S+)", 1).alias("value"))


def rsem_metrics(files: DataFrame) -> DataFrame:
    """Long rows of the first three lines of count files."""
    lines = F.split("text", "\n")
    values = F.map_from_arrays(
        F.array(*[F.lit(m) for line in RSEM_METRICS for m in line]),
        F.array(*[F.get(F.split(F.trim(F.get(lines, F.lit(i))), " +"), F.lit(j)) for i, line in enumerate(RSEM_METRICS) for j in range(len(line))]),
    )
    return files.select(sample_of(F.col("name"), "_rsem").alias("sample"), F.lit("RSEM").alias("class"), F.explode(values).alias("metric", "value"))


def pivoted(rows: DataFrame) -> DataFrame:
    """One row per sample, one column per metric: the names come from the data, in order."""
    names = [r["metric"] for r in rows.select("metric").distinct().orderBy("metric").collect()]  # columns of the table
    return rows.groupBy("sample").pivot("metric", names).agg(F.first("value"))


def with_classes(rows: DataFrame) -> DataFrame:
    """The pivoted table under a row Class, as the CSV outputs have it."""
    classes = rows.select(F.lit("Class").alias("sample"), "metric", F.col("class").alias("value")).distinct()
    table = pivoted(classes.unionByName(rows.select("sample", "metric", "value")))
    return table.orderBy(F.col("sample") != "Class", "sample")


def outer_merged(*tables: DataFrame, label: str = "sample") -> DataFrame:
    """Tables side by side by label, all labels of all."""
    return reduce(lambda a, b: a.join(b, label, "full_outer"), tables)
