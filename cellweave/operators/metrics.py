"""Quality metrics of cells and genes, and their merging.

Reads are pre-aggregated to fragments, then to molecules, then to (cell, gene) pairs, so that no aggregate
needs a distinct count and a cell with a third of all reads is summed by many tasks before it meets.
Means and variances come from a second aggregate with map-side sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import DUPLICATE, REVERSE, UNMAPPED, aligned_part, has_flag, mean_of, share_above, share_above_text, single_gene, spliced
from ..schema import CELL_METRICS, CODING, COMMON_METRICS, GENE_METRICS, INTERGENIC, INTRONIC, UTR
from .ordered import sorted_pairs


def read_features(alignments: DataFrame) -> DataFrame:
    """What the metrics need of each read: made once, before any shuffle."""
    genomic = aligned_part(F.col("qual"), F.col("cigar"))
    return alignments.select(
        "CB", "UB", "GE", "XF", "NH",
        (F.col("CB").isNotNull() & (F.col("CR") == F.col("CB"))).alias("perfect_cell"),
        F.coalesce(F.col("UR") == F.col("UB"), F.lit(False)).alias("perfect_molecule"),
        (~has_flag(F.col("flag"), UNMAPPED)).alias("mapped"),
        has_flag(F.col("flag"), REVERSE).alias("reverse"),
        has_flag(F.col("flag"), DUPLICATE).alias("duplicate"),
        spliced(F.col("cigar")).alias("spliced"),
        F.col("rname").alias("reference"), "pos",
        share_above_text(F.col("CY")).alias("cell_above"),
        share_above_text(F.col("UY")).alias("molecule_above"),
        share_above(genomic).alias("genomic_above"),
        mean_of(genomic).alias("genomic_mean"),
    )


def _spread(name: str, column: Column) -> list[Column]:
    return [F.avg(column).alias(f"{name}_mean"), F.var_samp(column).alias(f"{name}_variance")]


def _sums(features: DataFrame, entity: str, extra: Sequence[Column] = ()) -> DataFrame:
    mapped = F.col("mapped")
    known = mapped & F.col("XF").isNotNull()
    return features.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.lit(0).cast("long").alias("noise_reads"),
        F.count_if("perfect_molecule").alias("perfect_molecule_barcodes"),
        F.count_if(known & (F.col("XF") == CODING)).alias("reads_mapped_exonic"),
        F.count_if(known & (F.col("XF") == INTRONIC)).alias("reads_mapped_intronic"),
        F.count_if(known & (F.col("XF") == UTR)).alias("reads_mapped_utr"),
        F.count_if(mapped & (F.col("NH") == 1)).alias("reads_mapped_uniquely"),
        F.count_if(mapped & (F.col("NH") != 1)).alias("reads_mapped_multiple"),
        F.count_if(mapped & F.col("duplicate")).alias("duplicate_reads"),
        F.count_if(mapped & F.col("spliced")).alias("spliced_reads"),
        F.lit(0).cast("long").alias("antisense_reads"),
        *_spread("molecule_barcode_fraction_bases_above_30", F.col("molecule_above")),
        *_spread("genomic_reads_fraction_bases_quality_above_30", F.when(mapped, F.col("genomic_above"))),
        *_spread("genomic_read_quality", F.when(mapped, F.col("genomic_mean"))),
        F.count_if("perfect_cell").alias("perfect_cell_barcodes"),
        F.count_if(F.col("XF") == INTERGENIC).alias("reads_mapped_intergenic"),
        F.count_if(F.col("XF").isNull()).alias("reads_unmapped"),
        F.lit(0).cast("long").alias("reads_mapped_too_many_loci"),
        *_spread("cell_barcode_fraction_bases_above_30", F.col("cell_above")),
        *extra,
    )


def pairs(features: DataFrame) -> DataFrame:
    """One row per (cell, gene): reads, molecules, fragments and those with a single read."""
    fragments = features.groupBy("CB", "UB", "GE", "reference", "pos", "reverse", "mapped").agg(F.count(F.lit(1)).alias("n"))
    molecules = fragments.groupBy("CB", "UB", "GE").agg(F.sum("n").alias("reads"), F.count_if("mapped").alias("fragments"), F.count_if(F.col("mapped") & (F.col("n") == 1)).alias("single_fragments"))
    return molecules.groupBy("CB", "GE").agg(
        F.sum("reads").alias("reads"),
        F.count(F.lit(1)).alias("molecules"),
        F.sum("fragments").alias("fragments"),
        F.sum("single_fragments").alias("single_fragments"),
        F.count_if(F.col("reads") == 1).alias("single_molecules"),
    )


def _counts(table: DataFrame, entity: str, mitochondrial: DataFrame | None) -> DataFrame:
    found = [
        F.sum("molecules").alias("n_molecules"),
        F.sum("fragments").alias("n_fragments"),
        F.sum("single_fragments").alias("fragments_with_single_read_evidence"),
        F.sum("single_molecules").alias("molecules_with_single_read_evidence"),
    ]
    if entity == "CB":
        mito = F.lit(False)
        if mitochondrial is not None:
            names = mitochondrial.select(F.col("gene").alias("mito_gene")).distinct()
            table = table.join(names, table["GE"] == names["mito_gene"], "left")
            mito = F.col("mito_gene").isNotNull()
        found += [
            F.count(F.lit(1)).alias("n_genes"),
            F.count_if(F.col("reads") > 1).alias("genes_detected_multiple_observations"),
            F.count_if(mito).alias("n_mitochondrial_genes"),
            F.coalesce(F.sum(F.when(mito, F.col("reads"))), F.lit(0)).cast("long").alias("n_mitochondrial_molecules"),
        ]
    else:
        found += [F.count_if(F.col("reads") > 1).alias("number_cells_detected_multiple"), F.count(F.lit(1)).alias("number_cells_expressing")]
    return table.groupBy(F.col(entity).alias("entity")).agg(*found)


def _metrics(features: DataFrame, entity: str, mitochondrial: DataFrame | None, extra: Sequence[Column] = (), order: Sequence[str] | None = None) -> DataFrame:
    sums = _sums(features, entity, extra)
    counts = _counts(sorted_pairs(features, order) if order else pairs(features), entity, mitochondrial)
    both = sums.join(counts, sums[entity].eqNullSafe(counts["entity"])).drop("entity")
    both = both.withColumns({
        "reads_per_molecule": F.try_divide("n_reads", "n_molecules"),
        "reads_per_fragment": F.try_divide("n_reads", "n_fragments"),
        "fragments_per_molecule": F.try_divide("n_fragments", "n_molecules"),
    })
    if entity == "CB":
        both = both.withColumn("pct_mitochondrial_molecules", F.coalesce(F.try_divide(F.col("n_mitochondrial_molecules") * 100.0, F.col("n_reads")), F.lit(0.0)))
    return both


def required(alignments: DataFrame, *tags: str) -> DataFrame:
    """The alignments, all of which have to have these tags: the first without one is an error. XF and NH are for mapped ones only."""
    mapped = ~has_flag(F.col("flag"), 4)
    missing = F.coalesce(*[F.when((mapped if t in ("XF", "NH") else F.lit(True)) & F.col(t).isNull(), F.lit(t)) for t in tags])
    fault = F.raise_error(F.concat(F.lit("alignment "), F.col("qname"), F.lit(" without tag "), missing)).cast("boolean")
    return alignments.filter(F.when(missing.isNotNull(), fault).otherwise(F.lit(True)))


def cell_metrics(alignments: DataFrame, mitochondrial: DataFrame | None = None, drop_null: bool = False, extra: Mapping[str, Column] = MappingProxyType({}), strict: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """One row per cell barcode (null is one, unless dropped); mitochondrial: rows with column gene.

    extra: further aggregates over the columns of read_features, by name. strict: alignments without the tags that metrics are made of are an
    error; else they count in no metric of that tag. order: the tags CB, UB, GE as the alignments are sorted by them, file after file; molecules are
    then counted where they are, without a shuffle of reads, and another order is an error.
    """
    alignments = required(alignments, "UY", "CY", "XF", "NH") if strict else alignments
    rows = alignments.filter(F.col("CB").isNotNull()) if drop_null else alignments
    added = [c.alias(k) for k, c in extra.items()]
    return _metrics(read_features(rows), "CB", mitochondrial, added, order).select("CB", *COMMON_METRICS, *CELL_METRICS, *extra)


def gene_metrics(alignments: DataFrame, drop_null: bool = False, extra: Mapping[str, Column] = MappingProxyType({}), strict: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """One row per gene name (null is one, unless dropped); reads of several genes are left out. extra, strict, order: as for cells."""
    alignments = required(alignments, "UY", "XF", "NH") if strict else alignments
    rows = alignments.filter(single_gene(F.col("GE")) if drop_null else F.coalesce(single_gene(F.col("GE")), F.lit(True)))
    added = [c.alias(k) for k, c in extra.items()]
    return _metrics(read_features(rows), "GE", None, added, order).select("GE", *COMMON_METRICS, *GENE_METRICS, *extra)


def merge_cell_metrics(*chunks: DataFrame) -> DataFrame:
    """Chunks hold disjoint cells: their rows, one after the other."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


AVERAGED = tuple(c for c in COMMON_METRICS if c.endswith(("_mean", "_variance")))
RATIOS = {"reads_per_molecule": ("n_reads", "n_molecules"), "fragments_per_molecule": ("n_fragments", "n_molecules"), "reads_per_fragment": ("n_reads", "n_fragments")}
SUMMED = tuple(c for c in (*COMMON_METRICS, *GENE_METRICS) if c not in AVERAGED and c not in RATIOS)


def merge_gene_metrics(*chunks: DataFrame) -> DataFrame:
    """Counts are summed, means and variances weighted by reads (a missing one stays missing), ratios made anew.

    One chunk passes through unchanged, as do all its columns' values.
    """
    if len(chunks) == 1:
        return chunks[0]
    weights = F.sum("n_reads")
    merged = merge_cell_metrics(*chunks).groupBy("GE").agg(
        *[F.sum(c).alias(c) for c in SUMMED],
        *[F.nullif(F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(float("nan"))) * F.col("n_reads")), weights), F.lit(float("nan"))).alias(c) for c in AVERAGED],
    )
    return merged.withColumns({k: F.try_divide(a, b) for k, (a, b) in RATIOS.items()}).select("GE", *SUMMED, *AVERAGED, *RATIOS)
