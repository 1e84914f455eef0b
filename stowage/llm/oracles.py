"""DuckDB statements for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""

_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES["op4_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.d),
least AS (SELECT d, min(m) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept
FROM w JOIN least ON d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

ORACLES["op6_phrase_automata"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(35) t(k)),
each_word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.p) AS t
         FROM each_word e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id
"""

# A sketch of fewer rows than its size is exact, so at the size of the correctness tables quantiles are plain ranks.
_METRICS = (("symbol_share", "0.05"), ("repeat_share", "0.15"), ("dup_line_share", "0.15"), ("mean_word", "2.0"))
_AT = "list_sort(list({m}))[CAST(greatest(1, ceil({q} * count(*))) AS BIGINT)]"
_CUTS = ", ".join(f"{_AT.format(m=m, q='0.25')} AS {m}_a, {_AT.format(m=m, q='0.75')} AS {m}_b" for m, _ in _METRICS)
_HIGH = " OR ".join(f"{m} > {m}_b + (4.0::DOUBLE * ({m}_b - {m}_a) + {margin}::DOUBLE)" for m, margin in _METRICS)
_LOW = "mean_word < mean_word_a - (4.0::DOUBLE * (mean_word_b - mean_word_a) + 2.0::DOUBLE)"

ORACLES["op9_quality_rules"] = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
        FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) r(k) WHERE win.n > 1 GROUP BY 1),
counts AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM w LEFT JOIN again ON again.doc_id = w.doc_id),
full_counts AS (SELECT *, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM counts),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_share,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM full_counts),
cuts AS (SELECT lang, source, {_CUTS} FROM m WHERE n_words > 0 GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({_HIGH} OR {_LOW}, FALSE) AS kept
FROM m LEFT JOIN cuts ON m.lang IS NOT DISTINCT FROM cuts.lang AND m.source IS NOT DISTINCT FROM cuts.source
"""

# Bytes as two hexadecimal digits each; window i begins at byte i, from 0.
ORACLES["op10_suffix_array"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b
         FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
         UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY 1),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k
         FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY 1),
lost AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans FROM runs GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# crc32 of the decimal id, bit by bit. Runs are stretches of words equal to those q later; as they hold five such words at
# least, three words on are compared at once. A stretch whose period is a multiple of a smaller one's that covers it is none.
_CRC = """list_reduce(
  [4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
  lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS UBIGINT[]),
                           lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384::UBIGINT) ELSE d >> 1 END))"""

ORACLES["op11_periodic_runs"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w, CAST(xor({_CRC}, 4294967295::UBIGINT) AS BIGINT) AS h FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS e FROM w),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END)
        ELSE w END AS w FROM s),
each_word AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
tri AS (SELECT doc_id, n, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM tri l JOIN tri r
         ON l.doc_id = r.doc_id AND l.x = r.x AND l.y = r.y AND l.z = r.z AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
parts AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same),
found AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS len FROM parts GROUP BY doc_id, q, part HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (
           SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.q < f.q AND f.q % g.q = 0 AND g.s <= f.s AND g.s + g.len >= f.s + f.len)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS r FROM runs) WHERE r = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS t FROM each_word e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
