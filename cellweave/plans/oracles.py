"""DuckDB SQL for the results of the named queries."""

from __future__ import annotations

from .reads import GTF_SQL, READS_SQL, WHITELIST_SQL

WITH_WL = f"{READS_SQL}, {WHITELIST_SQL}"
#: Whether two texts of eight letters differ in one place at most.
NEAR = "hamming(CR, barcode) <= 1"
BASE_COUNTS = ", ".join(f"count(*) FILTER (letter = '{b}') AS \"{b}\"" for b in "ACTG")

_FRACTION = "len(list_filter({0}, lambda q: q > 30)) / nullif(len({0}), 0)"
FEATURES = f"""{READS_SQL}, f AS (
  SELECT CB, UB, GE, XF, NH, coalesce(CR = CB, false) AS perfect_cell, coalesce(UR = UB, false) AS perfect_molecule, NOT unmapped AS mapped, rev AS reverse,
         dup AS duplicate, spliced, rname AS reference, pos, {_FRACTION.format("cq")} AS cell_above, {_FRACTION.format("uq")} AS molecule_above,
         {_FRACTION.format("gq")} AS genomic_above, list_avg(gq) AS genomic_mean, file
  FROM reads)"""


def _metrics(entity: str, where: str = "true", extra: str = "", more: str = "", joins: str = "", source: str = "f", name: str = "m") -> str:
    """Common table expressions up to `name`: the metrics of an entity from distinct counts."""
    return f"""
, {name}_rows AS (SELECT * FROM {source} WHERE {where}),
{name}_molecules AS (SELECT CB, UB, GE, count(*) AS n FROM {name}_rows GROUP BY ALL),
{name}_fragments AS (SELECT CB, UB, GE, reference, pos, reverse, count(*) AS n FROM {name}_rows WHERE mapped GROUP BY ALL),
{name}_m AS (SELECT {entity} AS e, count(*) AS n_molecules, count(*) FILTER (n = 1) AS molecules_single FROM {name}_molecules GROUP BY ALL),
{name}_f AS (SELECT {entity} AS e, count(*) AS n_fragments, count(*) FILTER (n = 1) AS fragments_single FROM {name}_fragments GROUP BY ALL),
{name}_r AS (SELECT {entity} AS e, count(*) AS n_reads, CAST(0 AS BIGINT) AS noise_reads, count(*) FILTER (perfect_molecule) AS perfect_molecule_barcodes,
  count(*) FILTER (mapped AND XF = 'CODING') AS reads_mapped_exonic, count(*) FILTER (mapped AND XF = 'INTRONIC') AS reads_mapped_intronic, count(*) FILTER (mapped AND XF = 'UTR') AS reads_mapped_utr,
  count(*) FILTER (mapped AND NH = 1) AS reads_mapped_uniquely, count(*) FILTER (mapped AND NH <> 1) AS reads_mapped_multiple, count(*) FILTER (mapped AND duplicate) AS duplicate_reads,
  count(*) FILTER (mapped AND spliced) AS spliced_reads, CAST(0 AS BIGINT) AS antisense_reads,
  round(avg(molecule_above), 6) AS molecule_barcode_fraction_bases_above_30_mean, round(var_samp(molecule_above), 6) AS molecule_barcode_fraction_bases_above_30_variance,
  round(avg(genomic_above) FILTER (mapped), 6) AS genomic_reads_fraction_bases_quality_above_30_mean, round(var_samp(genomic_above) FILTER (mapped), 6) AS genomic_reads_fraction_bases_quality_above_30_variance,
  round(avg(genomic_mean) FILTER (mapped), 6) AS genomic_read_quality_mean, round(var_samp(genomic_mean) FILTER (mapped), 6) AS genomic_read_quality_variance{extra}
  FROM {name}_rows GROUP BY ALL),
{name} AS (SELECT r.* EXCLUDE (e), r.e AS {entity}, coalesce(n_molecules, 0) AS n_molecules, coalesce(n_fragments, 0) AS n_fragments,
  round(n_reads / nullif(n_molecules, 0), 6) AS reads_per_molecule, round(n_reads / nullif(n_fragments, 0), 6) AS reads_per_fragment, round(coalesce(n_fragments, 0) / nullif(n_molecules, 0), 6) AS fragments_per_molecule,
  coalesce(fragments_single, 0) AS fragments_with_single_read_evidence, molecules_single AS molecules_with_single_read_evidence{more}
  FROM {name}_r r LEFT JOIN {name}_m m ON r.e IS NOT DISTINCT FROM m.e LEFT JOIN {name}_f f ON r.e IS NOT DISTINCT FROM f.e {joins})"""


_CELL_EXTRA = """,
  count(*) FILTER (perfect_cell) AS perfect_cell_barcodes, count(*) FILTER (XF = 'INTERGENIC') AS reads_mapped_intergenic, count(*) FILTER (XF IS NULL) AS reads_unmapped,
  CAST(0 AS BIGINT) AS reads_mapped_too_many_loci, round(var_samp(cell_above), 6) AS cell_barcode_fraction_bases_above_30_variance, round(avg(cell_above), 6) AS cell_barcode_fraction_bases_above_30_mean"""
_CELL = f"""{FEATURES}, mito AS (SELECT DISTINCT p_brand FROM part WHERE p_size % 25 = 0),
genes_of AS (SELECT CB, GE, count(*) AS n, bool_or(p_brand IS NOT NULL) AS mito FROM f LEFT JOIN mito ON GE = p_brand GROUP BY ALL),
by_gene AS (SELECT CB, count(*) AS n_genes, count(*) FILTER (n > 1) AS genes_multiple, count(*) FILTER (mito) AS n_mito, CAST(coalesce(sum(n) FILTER (mito), 0) AS BIGINT) AS mito_reads FROM genes_of GROUP BY CB)
{_metrics("CB", extra=_CELL_EXTRA, more=''', n_genes, genes_multiple AS genes_detected_multiple_observations, n_mito AS n_mitochondrial_genes, mito_reads AS n_mitochondrial_molecules,
  round(coalesce(mito_reads * 100.0::DOUBLE / n_reads, 0), 6) AS pct_mitochondrial_molecules''', joins="LEFT JOIN by_gene g ON r.e IS NOT DISTINCT FROM g.CB")}
SELECT * FROM m"""
_GENE_CELLS = "cells_of AS (SELECT GE, {1}CB, count(*) AS n FROM f WHERE coalesce(instr(GE, ',') = 0, true) GROUP BY ALL), by_cell AS (SELECT GE, {1}count(*) AS expressing, count(*) FILTER (n > 1) AS multiple FROM cells_of GROUP BY ALL)"
_GENE_MORE = ", multiple AS number_cells_detected_multiple, expressing AS number_cells_expressing"
_GENE = f"""{FEATURES}, {_GENE_CELLS.format("", "")}
{_metrics("GE", "coalesce(instr(GE, ',') = 0, true)", more=_GENE_MORE, joins="LEFT JOIN by_cell c ON r.e IS NOT DISTINCT FROM c.GE")}
SELECT * FROM m"""


def _gene_chunks() -> str:
    """Metrics of genes by reference, merged with weights."""
    text = FEATURES + ", " + _GENE_CELLS.format("", "reference, ")
    for r in "ANR":
        text += _metrics("GE", f"coalesce(instr(GE, ',') = 0, true) AND reference = '{r}'", more=_GENE_MORE, joins=f"LEFT JOIN by_cell c ON r.e IS NOT DISTINCT FROM c.GE AND c.reference = '{r}'", name=f"m{r}").replace("round(", "(").replace(", 6)", ")")
    sums = ["n_reads", "noise_reads", "perfect_molecule_barcodes", "reads_mapped_exonic", "reads_mapped_intronic", "reads_mapped_utr", "reads_mapped_uniquely", "reads_mapped_multiple", "duplicate_reads", "spliced_reads", "antisense_reads", "n_molecules", "n_fragments", "fragments_with_single_read_evidence", "molecules_with_single_read_evidence", "number_cells_detected_multiple", "number_cells_expressing"]
    means = [f"{k}_{what}" for k in ("molecule_barcode_fraction_bases_above_30", "genomic_reads_fraction_bases_quality_above_30", "genomic_read_quality") for what in ("mean", "variance")]
    shown = [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sums] + [f"CASE WHEN count({c}) < count(*) THEN NULL ELSE round(sum({c} * n_reads) / sum(n_reads), 6) END AS {c}" for c in means]
    ratios = [f"round(sum({a}) / nullif(sum({b}), 0), 6) AS {k}" for k, a, b in (("reads_per_molecule", "n_reads", "n_molecules"), ("fragments_per_molecule", "n_fragments", "n_molecules"), ("reads_per_fragment", "n_reads", "n_fragments"))]
    return text + f" SELECT GE, {', '.join(shown + ratios)} FROM (SELECT * FROM mA UNION ALL BY NAME SELECT * FROM mN UNION ALL BY NAME SELECT * FROM mR) GROUP BY GE"


_COUNTED = f"""{READS_SQL}, usable AS (
  SELECT *, CASE WHEN XF <> 'INTERGENIC' AND instr(GE, ',') = 0 THEN GE END AS usable_gene FROM reads
), firsts AS (SELECT qname, CB, UB, rec FROM reads QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rec, CB, UB) = 1),
single AS (SELECT qname, min(usable_gene) AS gene FROM usable GROUP BY qname HAVING count(DISTINCT usable_gene) = 1),
counted AS (SELECT CB AS cell, UB AS molecule, gene, rec, qname FROM firsts JOIN single USING (qname) WHERE CB IS NOT NULL AND UB IS NOT NULL)"""

_CODES = "list_transform(string_split(barcode, ''), lambda c: {0})"
_CODE2 = "list_reduce(list_prepend(CAST(0 AS BIGINT), " + _CODES.format("CAST(CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'T' THEN 2 ELSE 3 END AS BIGINT)") + "), lambda s, x: s * 4 + x)"
_CODE3 = "list_reduce(list_prepend(CAST(0 AS BIGINT), " + _CODES.format("CAST(CASE c WHEN 'C' THEN 1 WHEN 'A' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 6 END AS BIGINT)") + "), lambda s, x: s * 8 + x)"
_GC = "CAST(length(regexp_replace(barcode, '[^GC]', '', 'g')) AS BIGINT) AS gc"
_LETTERS = "letters AS (SELECT unnest(range(length(b))) AS pos, unnest(string_split(b, '')) AS letter FROM (SELECT DISTINCT CR AS b FROM reads))"
_QUALITY = "list_transform(range(12), lambda i: (l_orderkey * 7 + i * 11) % 41)"
_KEYS = {"B": "coalesce(CB, '')", "U": "coalesce(UB, '')", "G": "coalesce(GE, '')"}
_ORDERS = ("BUG", "BGU", "UBG", "UGB", "GUB", "GBU")

_SCANNED = f"""{READS_SQL} SELECT rname, count(*) AS n, count(*) FILTER (unmapped) AS n_unmapped, count(*) FILTER (rev) AS n_reverse, count(*) FILTER (dup) AS n_duplicate, count(*) FILTER (spliced) AS n_spliced,
      CAST(sum(pos) AS BIGINT) AS score, CAST(sum(list_sum({_QUALITY})) AS BIGINT) AS quality, CAST(sum(NH) AS BIGINT) AS hits, count(DISTINCT CB) AS n_cells, count(DISTINCT GE) AS n_genes, count(*) AS n_typed FROM reads GROUP BY rname"""

ORACLES: dict[str, str] = {
    "scan_reads": _SCANNED,
    "scan_sam": _SCANNED,
    "attach_lanes": f"{READS_SQL} SELECT CR, UR, count(*) AS n, count(*) AS n_own FROM reads GROUP BY ALL",
    "broken_reads": f"""{READS_SQL}, at_ AS (SELECT *, (rec >> 32) % 8 AS k FROM reads)
SELECT CR AS barcode, 'kept' AS fault, count(*) AS n, count(*) AS n_alike FROM at_ WHERE k NOT IN (2, 3) GROUP BY CR
UNION ALL SELECT 'R1', 'the name doesn''t start with @', count(*), CAST(0 AS BIGINT) FROM at_ WHERE k = 2 HAVING count(*) > 0
UNION ALL SELECT 'R2', 'sequence and quality differ in length', count(*), CAST(0 AS BIGINT) FROM at_ WHERE k = 3 HAVING count(*) > 0
UNION ALL SELECT 'I1', 'sequence and quality differ in length', count(*), CAST(0 AS BIGINT) FROM at_ WHERE k = 2 HAVING count(*) > 0""",
    "scan_fastq": f"{READS_SQL} SELECT CR, UR, count(*) AS n, min(array_to_string(list_transform(cq, lambda q: chr(33 + q)), '')) AS least_quality FROM reads GROUP BY ALL",
    "select_by_index": f"{READS_SQL} SELECT qname, rec, count(*) AS n FROM (SELECT qname, rec, min(rec) OVER (PARTITION BY qname) AS least FROM reads) WHERE rec = least GROUP BY qname, rec",
    "zip_positional": "SELECT o_orderkey AS rec, o_orderstatus, c_mktsegment FROM orders, customer WHERE o_orderkey = c_custkey",
    "feature_filter": f"WITH {GTF_SQL} SELECT rec, seqname, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" AS BIGINT) AS \"end\" FROM gtf WHERE feature = 'exon'",
    "extract_fixed": f"{READS_SQL} SELECT substr(CR || UR, 1, 8) AS CR, substr(CR || UR, 9, 5) AS UR, count(*) AS n FROM reads GROUP BY 1, 2",
    "extract_read_structure": f"{READS_SQL} SELECT left(s, 3) || substr(s, 6, 3) AS CR, substr(s, 9, 4) AS UR, count(*) AS n FROM (SELECT CR || UR AS s FROM reads) GROUP BY 1, 2",
    "avg_quality": f"{READS_SQL} SELECT CR, round(min(list_avg(cq)), 6) AS q_min, round(max(list_avg(cq)), 6) AS q_max FROM reads GROUP BY CR",
    "frac_above_30": f"{FEATURES} SELECT reference AS rname, round(avg(cell_above), 6) AS cell, round(avg(genomic_above), 6) AS genomic FROM f GROUP BY 1",
    "features17": f"{FEATURES} SELECT CB, UB, GE, XF, CAST(NH AS BIGINT) AS NH, perfect_cell, perfect_molecule, mapped, reverse, duplicate, spliced, reference, CAST(pos AS BIGINT) AS pos, round(cell_above, 6) AS cell_above, round(molecule_above, 6) AS molecule_above, round(genomic_above, 6) AS genomic_above, round(genomic_mean, 6) AS genomic_mean FROM f",
    "first_tag": f"{READS_SQL} SELECT CASE WHEN CB IS NULL THEN CR ELSE CB END AS barcode, count(*) AS n FROM reads GROUP BY 1",
    "encode_two_bit": f"WITH {WHITELIST_SQL} SELECT barcode, {_CODE2} AS code, barcode AS decoded, {_GC} FROM wl",
    "encode_three_bit": f"WITH {WHITELIST_SQL} SELECT barcode, {_CODE3} AS code, barcode AS decoded, {_GC} FROM wl",
    "gc_content": f"{READS_SQL} SELECT CAST(length(regexp_replace(CR || UR, '[^GC]', '', 'g')) AS BIGINT) AS gc, count(*) AS n FROM reads GROUP BY 1",
    "hamming_distances": f"{READS_SQL} SELECT CAST(hamming(CB, CR) AS BIGINT) AS text_distance, CAST(hamming(CB, CR) AS BIGINT) AS code_distance, count(*) AS n FROM reads WHERE CB IS NOT NULL GROUP BY ALL",
    "read_flags": f"{READS_SQL} SELECT unmapped, rev AS reverse, dup AS duplicate, spliced, count(*) AS n FROM reads GROUP BY ALL",
    "whitelist_variants": f"""WITH {WHITELIST_SQL}, places AS (SELECT unnest(range(1, 9)) AS i), bases AS (SELECT unnest(['A','C','G','T','N']) AS b),
      v AS (SELECT left(barcode, CAST(i AS INTEGER) - 1) || b || substr(barcode, CAST(i AS INTEGER) + 1) AS variant, barcode, line_no FROM wl, places, bases)
      SELECT corrected, count(*) AS n_variants FROM (SELECT variant, arg_max(barcode, line_no) AS corrected FROM v GROUP BY variant) GROUP BY corrected""",
    "whitelist_correct": f"{WITH_WL} SELECT CR, arg_max(barcode, line_no) AS CB, any_value(n) AS n FROM (SELECT CR, count(*) AS n FROM reads GROUP BY CR) LEFT JOIN wl ON {NEAR} GROUP BY CR",
    "correct_fallback": f"{WITH_WL} SELECT coalesce(b, CR) AS CB, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CR, arg_max(barcode, line_no) AS b, any_value(n) AS n FROM (SELECT CR, count(*) AS n FROM reads GROUP BY CR) LEFT JOIN wl ON {NEAR} GROUP BY CR) GROUP BY 1",
    "correction_tally": f"""{WITH_WL}, c AS (SELECT CR, arg_max(barcode, line_no) AS b FROM (SELECT DISTINCT CR FROM reads) LEFT JOIN wl ON {NEAR} GROUP BY CR)
      SELECT file, count(*) AS n_reads, count(*) FILTER (b = CR) AS n_correct, count(*) FILTER (b <> CR) AS n_corrected, count(*) FILTER (b IS NULL) AS n_uncorrectable, round(count(*) FILTER (b IS NULL) * 100.0::DOUBLE / count(*), 6) AS pct_uncorrectable FROM reads JOIN c USING (CR) GROUP BY file""",
    "distinct_barcodes": f"{READS_SQL} SELECT DISTINCT coalesce(CB, CR) AS barcode FROM reads",
    "barcode_multiset": f"{READS_SQL} SELECT UR AS barcode, count(*) AS n FROM reads GROUP BY UR",
    "reads_per_barcode": f"{READS_SQL} SELECT CR AS barcode, count(*) AS n FROM reads GROUP BY CR",
    "base_frequency": f"{READS_SQL}, {_LETTERS} SELECT pos, {BASE_COUNTS} FROM letters GROUP BY pos",
    "effective_diversity": f"{READS_SQL}, {_LETTERS}, n AS (SELECT pos, letter, count(*) AS n FROM letters GROUP BY ALL), p AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS p FROM n) SELECT pos, round(abs(sum(p * ln(p) / ln(4.0))), 6) AS diversity FROM p GROUP BY pos",
    "position_weights": f"{READS_SQL}, l AS (SELECT unnest(range(1, length(UR) + 1)) AS position, unnest(string_split(UR, '')) AS letter FROM reads) SELECT position, {BASE_COUNTS}, count(*) FILTER (letter = 'N') AS \"N\" FROM l GROUP BY position",
    "hamming_summary": f"WITH {WHITELIST_SQL}, b AS (SELECT DISTINCT barcode FROM wl), d AS (SELECT hamming(x.barcode, y.barcode) AS d FROM b x, b y WHERE x.barcode < y.barcode) SELECT min(d)::DOUBLE AS minimum, quantile_cont(d, 0.25)::DOUBLE AS q25, quantile_cont(d, 0.5)::DOUBLE AS median, quantile_cont(d, 0.75)::DOUBLE AS q75, max(d)::DOUBLE AS maximum, round(avg(d), 6) AS average FROM d",
    "partition_disjoint": f"{READS_SQL} SELECT CB, count(DISTINCT file) AS parts FROM reads WHERE CB IS NOT NULL GROUP BY CB HAVING count(DISTINCT file) > 1",
    "cell_metrics": _CELL,
    "gene_metrics": _GENE,
    "online_stats": f"{READS_SQL} SELECT CB, UB, round(avg(pos), 6) AS mean, round(var_samp(pos), 6) AS variance FROM reads GROUP BY ALL",
    "native_cells": f"{_CELL} WHERE CB IS NOT NULL",
    "merge_cell": f"{_CELL} WHERE CB IS NOT NULL",
    "merge_gene": _gene_chunks(),
    "count_matrix": f"{_COUNTED} SELECT cell, gene, count(DISTINCT molecule) AS n FROM counted GROUP BY ALL",
    "count_matrix_genes": f"{_COUNTED}, {GTF_SQL}, known AS (SELECT gene, row_number() OVER (ORDER BY min(rec)) - 1 AS gene_index FROM gtf WHERE feature = 'gene' GROUP BY gene) SELECT cell, gene, gene_index, count(DISTINCT molecule) AS n FROM counted JOIN known USING (gene) GROUP BY ALL",
    "count_matrix_merge": f"{_COUNTED}, parts AS (SELECT cell, gene, CAST(substr(qname, 2) AS BIGINT) % 4 AS part, count(DISTINCT molecule) AS n FROM counted GROUP BY ALL) SELECT cell, gene, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY ALL",
    "cell_first_seen": f"{_COUNTED} SELECT cell, row_number() OVER (ORDER BY min(rec), cell) - 1 AS cell_index FROM counted GROUP BY cell",
    "streamed_molecules": "SELECT user_id, event_type, count(DISTINCT time_bucket(INTERVAL 10 MINUTE, ts)) AS n FROM events GROUP BY ALL",
    "streamed_increments": "SELECT user_id, event_type, count(DISTINCT time_bucket(INTERVAL 10 MINUTE, ts)) AS n FROM events GROUP BY ALL",
    "run_groups": f"""{READS_SQL}, marked AS (SELECT file, rec, GE, CASE WHEN row_number() OVER w = 1 OR GE IS DISTINCT FROM lag(GE) OVER w THEN 1 ELSE 0 END AS new FROM reads WINDOW w AS (PARTITION BY file ORDER BY rec)),
      numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY file ORDER BY rec ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM marked)
      SELECT file, run, GE, count(*) AS n, min(rec) AS first_rec FROM numbered GROUP BY ALL""",
    "query_groups": f"{READS_SQL} SELECT qname, count(*) AS n, min(rec) AS first_rec FROM reads GROUP BY qname",
    "verify_sort": f"""{READS_SQL}, l AS (SELECT file, coalesce(CB, '') AS b, coalesce(UB, '') AS u, lag(coalesce(CB, '')) OVER w AS pb, lag(coalesce(UB, '')) OVER w AS pu, qname, lag(qname) OVER w AS pq FROM reads WINDOW w AS (PARTITION BY file ORDER BY rec))
      SELECT file, count(*) AS n FROM l WHERE b < pb OR b = pb AND (u < pu OR u = pu AND qname < pq) GROUP BY file""",
    "tag_sort": f"{READS_SQL} SELECT rec, qname, CB, UB, GE FROM reads",
    "tag_order_permutations": f"{READS_SQL} " + " UNION ALL ".join(f"(SELECT '{o}' AS tags, rec, row_number() OVER (ORDER BY {', '.join(_KEYS[c] for c in o)}, qname, rec) - 1 AS place FROM reads)" for o in _ORDERS),
    "subset_chromosome": f"{READS_SQL} (SELECT rec, rname, qname FROM reads WHERE rname = 'A' ORDER BY rec LIMIT 20) UNION ALL (SELECT rec, rname, qname FROM reads WHERE rname <> 'A' ORDER BY rec LIMIT 5)",
    "split_bins": f"{READS_SQL}, k AS (SELECT coalesce(CB, CR) AS b FROM reads), r AS (SELECT b, (row_number() OVER (ORDER BY b) - 1) % 7 AS bin FROM (SELECT DISTINCT b FROM k)) SELECT bin, count(*) AS n, count(DISTINCT b) AS n_barcodes FROM k JOIN r USING (b) GROUP BY bin",
    "shard_hash": f"{READS_SQL} SELECT coalesce(CB, CR) AS barcode, count(*) AS n, CAST(1 AS BIGINT) AS shards, true AS known FROM reads GROUP BY ALL",
    "gene_index": f"WITH {GTF_SQL} SELECT gene, row_number() OVER (ORDER BY min(rec)) - 1 AS gene_index FROM gtf WHERE feature = 'gene' GROUP BY gene",
    "mito_genes": f"WITH {GTF_SQL} SELECT DISTINCT gene_id AS gene FROM gtf WHERE feature = 'gene' AND lower(gene) LIKE 'mt-%'",
    "gene_locations": f"WITH {GTF_SQL} SELECT seqname AS chromosome, gene, CAST(arg_max(\"start\", rec) AS BIGINT) AS \"start\", CAST(arg_max(\"end\", rec) AS BIGINT) AS \"end\" FROM gtf WHERE feature = 'gene' GROUP BY ALL",
    "gene_exons": f"WITH {GTF_SQL} SELECT seqname AS chromosome, gene, string_agg(\"start\" || '-' || \"end\", ',' ORDER BY rec) AS exons FROM gtf WHERE feature = 'exon' GROUP BY ALL",
    "interval_lookup": f"""WITH {GTF_SQL}, g AS (SELECT seqname, gene, arg_max("start", rec) AS s, arg_max("end", rec) AS e FROM gtf WHERE feature = 'gene' GROUP BY ALL)
      SELECT c_custkey, count(*) AS n, min(gene) AS gene FROM customer JOIN g ON seqname = 'chr' || (c_nationkey % 5) AND c_custkey * 13 > s AND c_custkey * 13 < e GROUP BY c_custkey""",
    "gtf_attributes": "SELECT p_partkey, 'G' || p_partkey AS gene_id, p_brand AS gene_name, p_type AS tag FROM part",
    "qc_pivot": "SELECT 's' || c_nationkey AS sample, " + ", ".join(f"nullif(CAST(count(*) FILTER (left(o_orderpriority, 1) = '{k}') AS VARCHAR), '0') AS N{k}" for k in range(1, 6)) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "qc_outer_merge": "WITH a AS (SELECT 's' || c_nationkey AS sample, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT 's' || s_nationkey AS sample, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT coalesce(a.sample, b.sample) AS sample, customers, suppliers FROM a FULL JOIN b ON a.sample = b.sample",
}
#: Values on the edge of rounding go up on both sides.
ORACLES = {name: sql.replace(", 6)", " + 1e-10, 6)") for name, sql in ORACLES.items()}
