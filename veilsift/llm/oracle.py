"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""

OP3 = r"""
WITH docs AS (
  SELECT doc_id, source IS NOT NULL AS has_source, coalesce(source, '') AS name,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda w: w <> '')) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents),
sources AS (
  SELECT has_source, name, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY has_source DESC, name) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY has_source, name),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, has_source DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, has_source DESC, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT *, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5('mix:' || has_source::INT::VARCHAR || ':' || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
held AS (
  SELECT d.*, t.source_size, t.target, t.shift,
    CASE WHEN d.size > 0.25::DOUBLE * t.target THEN 0 WHEN d.size > 0.0625::DOUBLE * t.target THEN 1
      WHEN d.size > 0.015625::DOUBLE * t.target THEN 2 WHEN d.size > 0.00390625::DOUBLE * t.target THEN 3 ELSE 4 END AS layer
  FROM docs d JOIN targets t USING (has_source, name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY has_source, name, layer ORDER BY size, h, doc_id) - 1 AS rank FROM held),
known0 AS (SELECT has_source, name, shift, target, source_size, source_size AS rest, 0.0::DOUBLE AS taken FROM targets),
""" + "".join(f"""
copies{k} AS (SELECT *, CASE WHEN rest > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, (target - taken) / rest::DOUBLE)) ELSE 0.0::DOUBLE END AS c FROM known{k}),
drawn{k} AS (
  SELECT r.doc_id, r.size, r.source_size, r.target, has_source, name, floor((rank + 1) * c + r.shift) - floor(rank * c + r.shift) AS times
  FROM ranked r JOIN copies{k} USING (has_source, name) WHERE layer = {k}),
known{k + 1} AS (
  SELECT k.has_source, k.name, k.shift, k.target, k.source_size, rest - coalesce(s, 0) AS rest, taken + coalesce(w, 0) AS taken
  FROM known{k} k LEFT JOIN (SELECT has_source, name, sum(size) AS s, sum(times * size) AS w FROM drawn{k} GROUP BY has_source, name) USING (has_source, name)),"""
    for k in range(5)) + """
drawn AS (SELECT * FROM drawn0 UNION ALL SELECT * FROM drawn1 UNION ALL SELECT * FROM drawn2 UNION ALL SELECT * FROM drawn3 UNION ALL SELECT * FROM drawn4)
SELECT doc_id, size::BIGINT AS size, source_size, target, (times::BIGINT * size)::BIGINT AS taken, times::BIGINT AS copies_taken FROM drawn
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
    unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w
  FROM docs WHERE len(words) >= 3),
twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim,
    length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars,
    len(list_filter(words, lambda w: regexp_matches(w, '\pL'))) AS n_letter_words
  FROM docs d LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words) AND NOT (100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3)
  AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT (5 * n_exclaim > n_words)
  AND NOT (5 * n_bars > n_words) AND NOT (10 * n_letter_words < 6 * n_words) AS kept
FROM judged
"""

ORACLES = {"op1_near_duplicates": OP1, "op3_mix_sources": OP3, "op7_quality_rules": OP7}
