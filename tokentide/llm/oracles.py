"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op1_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
  SELECT doc_id, c, length(h) // 2 AS n, substr(h, 2000 * c + 1, 2098) AS part FROM d, unnest(range(0, length(h) // 2000 + 1)) t(c)
),
win AS (
  SELECT doc_id, 1000 * c + k AS s, substr(part, 2 * k - 1, 100) AS x FROM parts, unnest(range(1, 1001)) t(k) WHERE 1000 * c + k <= n - 49
),
least AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x),
bad AS (SELECT doc_id, s FROM win JOIN least USING (x) WHERE first < doc_id),
bytes AS (
  SELECT doc_id, 1000 * c + k AS p, substr(part, 2 * k - 1, 2) AS b FROM parts, unnest(range(1, 1001)) t(k) WHERE 1000 * c + k <= n
),
marked AS (
  SELECT b.doc_id, b.p, b.b, max(bad.s) OVER (PARTITION BY b.doc_id ORDER BY b.p) AS last
  FROM bytes b LEFT JOIN bad ON bad.doc_id = b.doc_id AND bad.s = b.p
),
flags AS (SELECT doc_id, p, b, coalesce(p - last <= 49, false) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM flags),
sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM edges GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

SQL["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 7), ' ') AS x FROM d, unnest(range(1, len(w) - 6)) t(s)),
again AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT s + k) AS n_repeat_words
  FROM win JOIN again USING (doc_id, x), unnest(range(0, 8)) t(k) GROUP BY doc_id
),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (
  SELECT doc_id, host, line, {WORDS.replace("coalesce(text, '')", "line")} AS lw FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
normal AS (
  SELECT doc_id, host, line, len(lw) AS n, translate(array_to_string(lw, ' '), '{UPPER}', '{LOWER}') AS x FROM full_lines
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM normal GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
frequent AS (
  SELECT host, x, min(doc_id) AS keeper FROM normal JOIN hosts USING (host) GROUP BY host, x, host_docs
  HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.05 * host_docs
),
removed AS (SELECT doc_id, sum(n) AS removed_words FROM normal JOIN frequent USING (host, x) WHERE doc_id <> keeper GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.2 * n_words)) AS kept
FROM judged
"""

SQL["op9_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({WORDS}, lambda t: translate(t, '{UPPER}', '{LOWER}')) AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS x
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(s) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * o >= 75 * (sa.n + sb.n - o)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS c FROM sizes
  UNION
  SELECT both_ways.b, c FROM reach JOIN both_ways ON both_ways.a = reach.a
),
least AS (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a),
sets AS (SELECT doc_id, list_sort(list(x)) AS xs FROM sh GROUP BY doc_id),
classes AS (SELECT xs, count(*) AS class_size FROM sets GROUP BY xs)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(class_size, 1) AS class_size
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (xs)
"""

SQL["op10_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS x FROM d, unnest(range(1, len(w) - 33)) t(s)),
again AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
bad AS (SELECT doc_id, s FROM win JOIN again USING (x)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
marked AS (
  SELECT v.doc_id, v.p, v.word, max(bad.s) OVER (PARTITION BY v.doc_id ORDER BY v.p) AS last
  FROM words v LEFT JOIN bad ON bad.doc_id = v.doc_id AND bad.s = v.p
),
sums AS (
  SELECT doc_id, count(*) FILTER (p - last <= 34) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (coalesce(p - last > 34, true)) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

SQL["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, octet_length(encode(h)) AS payload_bytes, octet_length(encode(h)) >= 100 AND page_id <> first AS again FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, true AS intact
FROM d
"""

SQL["op12_hard_negatives"] = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
),
near AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM scored WHERE same QUALIFY k <= 5
),
fits AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM near p JOIN scored s ON p.rid = s.rid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 3
"""

SQL["op13_collocations"] = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, m, CAST(count(*) AS HUGEINT) AS a
  FROM p, unnest(range(1, 5)) t(m), unnest(range(1, len(w) - m + 2)) u(s) GROUP BY ALL HAVING count(*) >= 30
),
candidates AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, 2000000 * c.a // (x.a + y.a) AS score
  FROM candidates c, unnest(range(1, m)) t(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase, max(a) AS longest
  FROM candidates, unnest(range(2, m)) t(n), unnest(range(1, m - n + 2)) u(s) GROUP BY ALL
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE i.longest IS NULL OR 100 * i.longest < 80 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
