"""DuckDB SQL for the results of those queries that SQL can express."""

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

PASSAGES = r"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS piece FROM pieces
), placed AS (
  SELECT doc_id, i, regexp_extract(piece, '[^\x20\x09-\x0D]+') AS word, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS "end" FROM numbered
), texts AS (
  SELECT doc_id, list(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY i) AS words FROM placed GROUP BY doc_id
), windows AS (
  SELECT doc_id, words, unnest(range(len(words) - 49)) AS i FROM texts WHERE len(words) >= 50
), hashed AS (
  SELECT w.doc_id, w.i, md5(array_to_string(words[w.i + 1 : w.i + 50], ' ')) AS same, "end" - length(word) AS start
  FROM windows w JOIN placed p ON p.doc_id = w.doc_id AND p.i = w.i
), ranked AS (
  SELECT *, row_number() OVER o AS k, first_value(doc_id) OVER o AS keep_doc_id, first_value(start) OVER o AS keep_start
  FROM hashed WINDOW o AS (PARTITION BY same ORDER BY doc_id, start)
), marked AS (
  SELECT *, coalesce(i > lag(i) OVER o + 50, TRUE) AS fresh FROM ranked WHERE k > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), joined AS (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, min(start) AS start, min(i) AS first, max(i) + 49 AS last, arg_min(keep_doc_id, i) AS keep_doc_id, arg_min(keep_start, i) AS keep_start
  FROM joined GROUP BY doc_id, span
)
SELECT s.doc_id, s.start, p."end", CAST(last - first + 1 AS BIGINT) AS n_words, CAST(1 AS BIGINT) AS n_rows, keep_doc_id, keep_start
FROM spans s JOIN placed p ON p.doc_id = s.doc_id AND p.i = s.last
"""

LINES = f"""
WITH pages AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, source, unnest(range(len(parts))) AS k, unnest(parts) AS line FROM pages
), totals AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
seen AS (
  SELECT source, trim(line, {BLANK}) AS bare, count(DISTINCT doc_id) AS pages
  FROM numbered WHERE trim(line, {BLANK}) <> '' GROUP BY ALL
), boring AS (
  SELECT source, bare FROM seen JOIN totals USING (source) WHERE pages >= 5 AND pages > n * 0.01
), marked AS (
  SELECT doc_id, k, line, b.bare IS NOT NULL AS gone
  FROM numbered x LEFT JOIN boring b ON x.source = b.source AND trim(line, {BLANK}) = b.bare
), joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM joined
"""

RULES = r"""
WITH worded AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(words) - 2)) AS i, words FROM worded WHERE len(words) > 2
), tripled AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i + 1], words[i + 2], words[i + 3]) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM tripled, range(3) AS r(j) WHERE tripled.n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM worded) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) FILTER (base_failed) AS failed, count(*) AS docs FROM judged GROUP BY source
), prior AS (
  SELECT avg(failed / docs) AS mean, var_pop(failed / docs) AS spread FROM hosts
), strong AS (
  SELECT mean, CASE WHEN spread <= 0 THEN 1e12 ELSE greatest(mean * (1 - mean) / spread - 1, 0) END AS strength FROM prior
), bad AS (
  SELECT source, (failed + mean * strength) / (docs + strength) > 0.5 AS host_failed FROM hosts, strong
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN bad b ON j.source IS NOT DISTINCT FROM b.source
"""

MIX = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), sources AS (
  SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY source
), shares AS (
  SELECT source, tokens, tokens / (SELECT sum(tokens) FROM sources) AS p FROM sources WHERE tokens > 0
), entropies AS (
  SELECT 0 AS round, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT round + 1, CASE WHEN good THEN middle ELSE low END, CASE WHEN good THEN high ELSE middle END
  FROM (SELECT round, low, high, middle,
          (SELECT ln(sum(p ** middle)) - middle * sum(p ** middle * ln(p)) / sum(p ** middle) >= 0.99 * ln(count(*)) - 1e-12 FROM shares) AS good
        FROM (SELECT *, CASE WHEN round = 0 THEN 1.0 ELSE (low + high) / 2 END AS middle FROM entropies) WHERE round < 60)
), wanted AS (
  SELECT arg_max(low, round) AS a FROM entropies
), limited AS (  -- the most frequent source is dealt out once, the least frequent (most / least) ** (1 - a) times
  SELECT greatest(a, 1 - ln(2.0) / greatest(ln((SELECT max(p) / min(p) FROM shares)), 1e-12)) AS a FROM wanted
), weighted AS (
  SELECT source, tokens, p ** a / (SELECT sum(p ** a) FROM shares) AS weight FROM shares, limited
), budgets AS (
  SELECT *, CAST(round(weight * (SELECT max(tokens / weight) FROM weighted)) AS BIGINT) AS budget FROM weighted
), blocks AS (
  SELECT s.source, coalesce(weight, 0.0) AS weight, CASE WHEN budget IS NULL THEN 1 ELSE budget // s.tokens::BIGINT END AS epochs,
         CASE WHEN budget IS NULL THEN 0 ELSE budget % s.tokens::BIGINT END AS rest
  FROM sources s LEFT JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
), keyed AS (
  SELECT doc_id, r.source, n_tokens, weight, epochs, rest, sum(n_tokens) OVER (PARTITION BY r.source ORDER BY ('0x' || substr(md5('7-' || epochs || '-' || doc_id), 1, 15))::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows_ r JOIN blocks b ON r.source IS NOT DISTINCT FROM b.source
), copied AS (
  SELECT doc_id, source, n_tokens, weight, unnest(range(CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS block FROM keyed
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(block AS BIGINT) AS block, ('0x' || substr(md5('7-' || block || '-' || doc_id), 1, 15))::BIGINT AS key
FROM copied
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), cut_ AS (
  SELECT doc_id, words, unnest(range(greatest(len(words) - 3, 1))) AS i FROM worded WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 4], ' ') AS s FROM cut_
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM both_ UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

RESAMPLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
), words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counts AS (
  SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL
), byte_lists AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM counts)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM byte_lists, crc
), sums AS (
  SELECT bucket, CAST(sum(n) FILTER (side = 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (side = 1) AS DOUBLE) AS t FROM counts JOIN hashed USING (w) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, totals
), weighed AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM counts JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS DOUBLE) AS h
  FROM documents d LEFT JOIN weighed USING (doc_id)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM noisy
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""


def _cluster_sql(clusters: int = 8, rounds: int = 10) -> str:
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept)",
        f"""firsts AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v FROM kept QUALIFY j < {clusters})""",
        "c0 AS MATERIALIZED (SELECT j, unnest(range(64)) AS i, unnest(v) AS y FROM firsts)",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT r, j, sum((x - y) * (x - y)) AS d FROM x JOIN c{k} USING (i) GROUP BY r, j)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, j, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if k < rounds:
            moved = f"SELECT j, i, (s - ((s % n) + n) % n) // n AS y FROM (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY j, i)"
            steps.append(f"c{k + 1} AS MATERIALIZED ({moved} UNION ALL SELECT j, i, y FROM c{k} WHERE j NOT IN (SELECT j FROM a{k}))")
    steps.append(f"named AS (SELECT j, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)")
    steps.append(f"inertias AS (SELECT j, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY j)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM inertias) AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named USING (j) JOIN inertias USING (j)"""


ORACLES = {
    "op1_exact_content_sort": EXACT,
    "op4_repeated_units": PASSAGES,
    "op5_site_lines": LINES,
    "op8_temperature_mix": MIX,
    "op9_jaccard_join": JACCARD,
    "op10_quality_rules": RULES,
    "op11_importance_resample": RESAMPLE,
    "op13_block_clusters": _cluster_sql(),
}
