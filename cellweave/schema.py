"""Tags, schemas and the column orders that outputs promise."""

from __future__ import annotations

from pyspark.sql import types as T

#: Alignment tags.
CELL, CELL_RAW, CELL_QUALITY = "CB", "CR", "CY"
MOLECULE, MOLECULE_RAW, MOLECULE_QUALITY = "UB", "UR", "UY"
SAMPLE_RAW, SAMPLE_QUALITY = "SR", "SY"
GENE, LOCATION, HITS = "GE", "XF", "NH"
INTRONIC, CODING, UTR, INTERGENIC = "INTRONIC", "CODING", "UTR", "INTERGENIC"
TEXT_TAGS = ("CB", "CR", "CY", "UB", "UR", "UY", "SR", "SY", "GE", "XF")

#: Metric columns in their order of output.
COMMON_METRICS = (
    "n_reads", "noise_reads", "perfect_molecule_barcodes", "reads_mapped_exonic", "reads_mapped_intronic", "reads_mapped_utr",
    "reads_mapped_uniquely", "reads_mapped_multiple", "duplicate_reads", "spliced_reads", "antisense_reads",
    "molecule_barcode_fraction_bases_above_30_mean", "molecule_barcode_fraction_bases_above_30_variance",
    "genomic_reads_fraction_bases_quality_above_30_mean", "genomic_reads_fraction_bases_quality_above_30_variance",
    "genomic_read_quality_mean", "genomic_read_quality_variance", "n_molecules", "n_fragments", "reads_per_molecule",
    "reads_per_fragment", "fragments_per_molecule", "fragments_with_single_read_evidence", "molecules_with_single_read_evidence",
)
CELL_METRICS = (
    "perfect_cell_barcodes", "reads_mapped_intergenic", "reads_unmapped", "reads_mapped_too_many_loci",
    "cell_barcode_fraction_bases_above_30_variance", "cell_barcode_fraction_bases_above_30_mean", "n_genes",
    "genes_detected_multiple_observations", "n_mitochondrial_genes", "n_mitochondrial_molecules", "pct_mitochondrial_molecules",
)
GENE_METRICS = ("number_cells_detected_multiple", "number_cells_expressing")

FASTQ = T.StructType([T.StructField("file", T.StringType()), T.StructField("rec", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("name", "sequence", "name2", "quality")]])
ALIGNMENTS = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("rec", T.LongType()), T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()), T.StructField("rname", T.StringType()), T.StructField("ref_id", T.IntegerType()),
        T.StructField("pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()), T.StructField("cigar", T.StringType()),
        T.StructField("rnext", T.StringType()), T.StructField("pnext", T.IntegerType()), T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()), T.StructField("qual", T.ArrayType(T.IntegerType())),
        *[T.StructField(t, T.StringType()) for t in TEXT_TAGS], T.StructField("NH", T.IntegerType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tag_types", T.MapType(T.StringType(), T.StringType())),
    ]
)
