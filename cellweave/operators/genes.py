"""Genes out of GTF rows: names, mitochondrial ones, places, exons, and what lies within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import dense_index


def attributes(text: Column) -> Column:
    """The attribute column as a map. Keys end at the first space, quotes go, the last of repeated keys stays."""
    fields = F.filter(F.transform(F.split(F.rtrim(F.regexp_replace(text, r"[;\n]+$", "")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(fields, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("key"), F.translate(F.regexp_extract(x, r"^\S+ ?(.*)$", 1), '"', "").alias("value")))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def features(gtf: DataFrame, *kinds: str) -> DataFrame:
    return gtf.filter(F.col("feature").isin(list(kinds)))


def named_genes(gtf: DataFrame) -> DataFrame:
    """Gene rows with gene_name and gene_id; one without a name is an error."""
    name = F.element_at("attributes", "gene_name")
    checked = F.coalesce(name, F.raise_error(F.concat(F.lit("gene without gene_name in line "), F.col("rec").cast("string"))).cast("string"))
    return features(gtf, "gene").withColumn("gene", checked).withColumn("gene_id", F.element_at("attributes", "gene_id"))


def gene_index(gtf: DataFrame) -> DataFrame:
    """gene, gene_index: distinct names in the order in which they come first."""
    firsts = named_genes(gtf).groupBy("gene").agg(F.min("rec").alias("rec"))
    return dense_index(firsts, ["rec"], "gene_index").select("gene", "gene_index")


def repeated_names(gtf: DataFrame) -> DataFrame:
    return named_genes(gtf).groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mitochondrial_genes(gtf: DataFrame, names: DataFrame | None = None, match_on: str = "gene_id") -> DataFrame:
    """gene: the ids (or match_on='gene': the names) of genes whose name starts with mt-, or is in names (column gene)."""
    rows = named_genes(gtf)
    mito = rows.filter(F.col("gene").rlike("(?i)^mt-"))
    if names is not None:
        mito = mito.unionByName(rows.join(names.select("gene").distinct(), "gene", "left_semi").select(*rows.columns))
    return mito.select(F.col(match_on).alias("gene")).distinct()


def gene_places(gtf: DataFrame) -> DataFrame:
    """chromosome, start, end, gene, in rows; of a name that comes again on a chromosome the last place."""
    rows = named_genes(gtf).groupBy(F.col("seqname").alias("chromosome"), "gene").agg(F.max_by(F.struct("start", "end"), "rec").alias("at"))
    return rows.select("chromosome", F.col("at.start").alias("start"), F.col("at.end").alias("end"), "gene")


def gene_places_sorted(gtf: DataFrame) -> DataFrame:
    """chromosome, genes: array of {start, end, gene} by start and end."""
    return gene_places(gtf).groupBy("chromosome").agg(F.array_sort(F.collect_list(F.struct("start", "end", "gene"))).alias("genes"))


def gene_exons(gtf: DataFrame) -> DataFrame:
    """chromosome, gene, exons: array of {start, end} in the order of the file."""
    name = F.element_at("attributes", "gene_name")
    rows = features(gtf, "exon").filter(name.isNotNull()).groupBy(F.col("seqname").alias("chromosome"), name.alias("gene"))
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("rec", "start", "end"))).alias("x"))
    return lists.select("chromosome", "gene", F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("exons"))


def containing(points: DataFrame, intervals: DataFrame, width: int = 1 << 16) -> DataFrame:
    """points (chromosome, at, ...) with the intervals (chromosome, start, end, ...) they lie strictly inside.

    Intervals are copied to the bins of width bases that they touch, so the join is by chromosome and bin.
    """
    bins = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    bins = bins.select(F.col("chromosome").alias("its"), "bin", *[c for c in intervals.columns if c != "chromosome"])
    dealt = points.withColumn("its_bin", F.floor(F.col("at") / width))
    inside = (F.col("chromosome") == F.col("its")) & (F.col("its_bin") == F.col("bin")) & (F.col("start") < F.col("at")) & (F.col("at") < F.col("end"))
    return dealt.join(bins, inside).drop("its", "bin", "its_bin")


def set_attribute(gtf: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows with an attribute added or replaced."""
    others = F.map_filter("attributes", lambda k, _: k != key)
    return gtf.withColumn("attributes", F.map_concat(others, F.create_map(F.lit(key), value.cast("string"))))


def identity(gtf: DataFrame) -> Column:
    """A hash of a row's text: equal for equal rows."""
    return F.xxhash64(serialised(gtf))


def size(start: Column, end: Column) -> Column:
    """end - start; less than 0 is an error."""
    return F.when(end >= start, end - start).otherwise(F.raise_error(F.lit("feature ends before it starts")).cast("int"))


def serialised(gtf: DataFrame) -> Column:
    """A row as a line of text, its attributes as key "value" pairs."""
    shown = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('"'))), "; ")
    return F.concat(F.concat_ws("\t", *[gtf[c].cast("string") for c in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame")]), F.lit("\t"), shown, F.lit(";"))
