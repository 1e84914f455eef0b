"""DuckDB SQL for the registered queries, written independently of the operators.

Each statement is assembled from named common table expressions, so that every
query states only what is its own.
"""

from __future__ import annotations

from .queries import PARTIAL_SAMPLE
from .views import EXPORT_PREFIX

# Extensions by type, stated here for themselves so that the SQL does not rest on the code it checks.
FILE_TYPES = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".heic", ".raw", ".tiff", ".svg"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a"],
    "document": [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".odt"],
    "data": [".json", ".xml", ".csv", ".html", ".htm"],
}

CTES: dict[str, str] = {}
USES: dict[str, list[str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, uses: str, sql: str) -> None:
    USES[name], CTES[name] = uses.split(), sql


def oracle(name: str, uses: str, sql: str) -> None:
    order: list[str] = []

    def add(part: str) -> None:
        for other in USES[part]:
            add(other)
        if part not in order:
            order.append(part)

    for part in uses.split():
        add(part)
    head = ",\n".join(f"{part} AS ({CTES[part].strip()})" for part in order)
    with_ = "WITH RECURSIVE" if "walk(" in sql else "WITH"
    ORACLES[name] = f"{with_} {head}\n{sql.strip()}" if head else sql.strip()


def name_of(path: str) -> str:
    return f"regexp_replace({path}, '^.*/', '')"


def suffix_of(path: str) -> str:
    return f"lower(regexp_extract({name_of(path)}, '^.+(\\.[^.]+)$', 1))"


def stem_of(path: str) -> str:
    return f"regexp_replace({name_of(path)}, '^(.+)\\.[^.]+$', '\\1')"


def norm_of(path: str) -> str:
    inner = f"regexp_replace({name_of(path)}, '^(.*)\\(\\d+\\)(\\.[^.]+)$', '\\1\\2')"
    return f"lower(regexp_replace({inner}, '\\(\\d+\\)$', ''))"


def type_of(path: str) -> str:
    cases = " ".join(
        f"WHEN {suffix_of(path)} IN ({', '.join(repr(e) for e in exts)}) THEN '{label}'"
        for label, exts in FILE_TYPES.items()
    )
    return f"CASE {cases} ELSE 'other' END"


def size_text_of(size: str, units: str) -> str:
    names = units.split()
    cases = " ".join(
        f"WHEN {size} < {1024 ** (i + 1)} THEN printf('%.1f {u}', ({size}) / {1024.0 ** i!r}::DOUBLE)"
        for i, u in enumerate(names[:-1])
    )
    return f"CASE {cases} ELSE printf('%.1f {names[-1]}', ({size}) / {1024.0 ** (len(names) - 1)!r}::DOUBLE) END"


REPORT_UNITS = "B KB MB GB TB"
PLAN_UNITS = "B KB MB GB TB PB"
EXTS = "['.jpg', '.mp4', '.mp3', '.pdf', '.json', '.bin']"
DOC_TYPES = ["image", "video", "audio", "document", "data", "other"]

# Views --------------------------------------------------------------------

cte("doc", "", f"""
SELECT source || '-' || lang || '.zip' AS archive,
       TIMESTAMP '2024-01-01' + to_days(CAST(substr(source, 4) AS INTEGER)) AS archive_mtime,
       doc_id AS entry_ix,
       'Data/' || lang || '/' || CASE doc_id % 5 WHEN 0 THEN 'copy_' || doc_id WHEN 1 THEN 'alt_' || n_chars
            WHEN 2 THEN 'scan_of_a_rather_long_document_title_number_' || n_chars
            ELSE 'doc_' || n_chars END
         || (['', '(1)', '(2)'])[1 + doc_id % 3] || ({EXTS})[1 + n_chars % 6] AS file_path,
       CAST(strlen(text) AS BIGINT) AS file_size,
       CASE WHEN doc_id % 11 = 0 THEN 1980 ELSE year(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER)) END AS zip_y,
       month(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER)) AS zip_mo,
       day(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER)) AS zip_d,
       doc_id % 24 AS zip_h, n_chars % 60 AS zip_mi, doc_id AS file_crc,
       sha256(text) AS content_hash, strlen(text) || '_' || sha256(text) AS content_key,
       text, lang
FROM documents
""")
cte("docx", "doc", """
SELECT * FROM doc
UNION ALL
SELECT * REPLACE ('zz_copy_' || archive AS archive, archive_mtime + INTERVAL 100 DAY AS archive_mtime)
FROM doc WHERE lang = 'es'
""")
cte("li", "", f"""
SELECT '{EXPORT_PREFIX}-' || strftime(l_shipdate, '%Y%m') || '01T000000Z-' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 3, '0') || '.zip' AS archive,
       date_trunc('month', l_shipdate)::TIMESTAMP AS archive_mtime,
       'Photos/' || l_returnflag || '/IMG_' || l_partkey
         || CASE WHEN l_linenumber > 1 THEN '(' || l_linenumber || ')' ELSE '' END
         || ({EXTS})[1 + l_partkey % 6] AS file_path,
       CAST(l_quantity AS BIGINT) * 1000 + l_partkey % 997 AS file_size,
       l_partkey * 100 + CAST(l_quantity AS BIGINT) AS file_crc,
       l_shipdate AS file_date,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
FROM lineitem
""")
cte("dir", "doc", f"""
SELECT 'library' AS root, lang || '/' || entry_ix || '_' || {name_of('file_path')} AS file_path, file_size,
       make_timestamp(2023, 6, 1, zip_h, zip_mi, 0) AS mtime, content_hash, content_key, text, entry_ix, lang
FROM doc WHERE lang = 'en' OR entry_ix IN (SELECT doc_id FROM labels)
""")
cte("side", "doc", f"""
SELECT coalesce(archive, 'events.zip') AS archive,
       CASE WHEN file_path IS NULL THEN 'Data/event_' || event_id || '.json'
            WHEN k % 3 = 0 THEN file_path || '.json'
            WHEN k % 3 = 1 THEN regexp_replace(file_path, '\\.[^.]+$', '') || '.json'
            ELSE 'Other/' || left({name_of('file_path')}, 46) || '.json' END AS json_path,
       CASE WHEN k % 7 = 0 THEN NULL
            ELSE TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) END AS taken
FROM (SELECT event_id, ts, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events) e
LEFT JOIN doc ON doc.entry_ix = e.event_id
""")
cte("dated", "side", """
SELECT archive, json_path, max(taken) AS taken FROM side WHERE taken IS NOT NULL GROUP BY ALL
""")
cte("tags", "doc", """
SELECT coalesce(archive, 'orders.zip') AS archive, coalesce(file_path, 'order_' || o_orderkey || '.jpg') AS file_path,
       CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 'F' THEN 'unknown' END AS dto,
       strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS dt
FROM orders LEFT JOIN doc ON o_orderkey = entry_ix
""")
cte("tag1", "tags", """
SELECT archive, file_path, dto, dt FROM (
  SELECT *, row_number() OVER (PARTITION BY archive, file_path ORDER BY dto NULLS FIRST, dt NULLS FIRST) AS r FROM tags
) WHERE r = 1
""")
cte("dcache", "doc", """
SELECT archive, file_path, file_size + toxic AS file_size, entry_ix AS file_crc,
       CASE WHEN quality = 1 THEN CAST(DATE '2001-01-01' + CAST(entry_ix % 3650 AS INTEGER) AS TIMESTAMP) END AS extracted_date,
       TIMESTAMP '2024-06-01' AS created_at
FROM doc JOIN labels ON doc_id = entry_ix
""")
cte("hcache", "dir", """
SELECT root, file_path, file_size + toxic AS file_size,
       mtime + CASE WHEN quality = 1 THEN INTERVAL 500 MILLISECOND ELSE INTERVAL 1500 MILLISECOND END AS mtime,
       'cached_' || content_key AS content_key
FROM dir JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) ON doc_id = entry_ix
""")

# Dedup --------------------------------------------------------------------

LINE_ORDER = "archive, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def dedup_ctes(prefix: str, source: str, order: str, key: str, mode: str = "two_stage") -> None:
    cte(f"{prefix}_grp", source, f"""
    SELECT *, count(*) OVER (PARTITION BY file_size, norm) AS n, min(rn) OVER (PARTITION BY file_size, norm) AS gfirst
    FROM (SELECT *, {norm_of('file_path')} AS norm, {key} AS ck, row_number() OVER (ORDER BY {order}) AS rn FROM {source})
    """)
    dk = "CASE WHEN n = 1 THEN 'u' || rn ELSE ck END" if mode == "two_stage" else "ck"
    rank = "gfirst, rn" if mode == "two_stage" else "rn"
    cte(f"{prefix}", f"{prefix}_grp", f"""
    SELECT * EXCLUDE (pos), pos > 1 AS is_duplicate FROM (
      SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY dk) AS group_size,
             first_value(archive) OVER w AS original_archive, first_value(file_path) OVER w AS original_path
      FROM (SELECT *, {dk} AS dk FROM {prefix}_grp)
      WINDOW w AS (PARTITION BY dk ORDER BY {rank}))
    """)


dedup_ctes("ded", "docx", "archive, entry_ix", "content_key")
dedup_ctes("dedc", "docx", "archive, entry_ix", "content_key", "content_only")
dedup_ctes("lded", "li", LINE_ORDER, "file_size || '_' || file_crc")

# Dates --------------------------------------------------------------------


def resolved_sql(source: str, sidecar: bool = True, cache: bool = False) -> str:
    name = name_of("s.file_path")
    json = "coalesce(e.taken, t.taken, p.taken)" if sidecar else "CAST(NULL AS TIMESTAMP)"
    hit = "c.extracted_date" if cache else "CAST(NULL AS TIMESTAMP)"
    return f"""
    SELECT * EXCLUDE (hit, js, ex, zd), coalesce(hit, js, ex, zd, archive_mtime) AS file_date,
           CASE WHEN hit IS NOT NULL THEN 'cache' WHEN js IS NOT NULL THEN 'json' WHEN ex IS NOT NULL THEN 'exif'
                WHEN zd IS NOT NULL THEN 'zip' ELSE 'fallback' END AS date_source
    FROM (SELECT s.*, {hit} AS hit, {json} AS js,
        CASE WHEN {suffix_of('s.file_path')} IN ('.jpg', '.jpeg', '.tiff', '.tif') AND s.file_size > 0 THEN
             CASE WHEN g.dto IS NOT NULL THEN try_strptime(g.dto, '%Y:%m:%d %H:%M:%S')
                  ELSE try_strptime(g.dt, '%Y:%m:%d %H:%M:%S') END END AS ex,
        CASE WHEN zip_y > 1980 THEN make_timestamp(zip_y, zip_mo, zip_d, zip_h, zip_mi, 0) END AS zd
      FROM {source} s
      LEFT JOIN dcache c ON c.archive = s.archive AND c.file_path = s.file_path AND c.file_size = s.file_size
           AND c.file_crc = s.file_crc AND c.extracted_date IS NOT NULL
      LEFT JOIN dated e ON e.archive = s.archive AND e.json_path = s.file_path || '.json'
      LEFT JOIN dated t ON t.archive = s.archive AND t.json_path = regexp_replace(s.file_path, '[^/]*$', '') || {stem_of('s.file_path')} || '.json'
      LEFT JOIN (SELECT archive, left({name_of('json_path')}, 40) AS prefix, arg_min(taken, json_path) AS taken
                 FROM dated WHERE length({name_of('json_path')}) >= 40 GROUP BY ALL) p
           ON p.archive = s.archive AND length({name}) > 40 AND p.prefix = left({name}, 40)
      LEFT JOIN tag1 g ON g.archive = s.archive AND g.file_path = s.file_path)
    """


LOOKUPS = "dated tag1 dcache"
cte("res", f"docx {LOOKUPS}", resolved_sql("docx"))
cte("resc", f"docx {LOOKUPS}", resolved_sql("docx", cache=True))
cte("docres", f"doc {LOOKUPS}", resolved_sql("doc", cache=True))
cte("single", f"doc {LOOKUPS}", resolved_sql("doc", sidecar=False))
cte("cat", f"ded {LOOKUPS}", f"""
SELECT *, 'extracted/' || strftime(file_date, '%Y/%m/') || {name_of('file_path')} AS proposed_location
FROM ({resolved_sql('ded')})
""")

# Expressions --------------------------------------------------------------

DOC = "archive, entry_ix"
oracle("content_key_full", "doc", f"SELECT {DOC}, content_key FROM doc")
S = PARTIAL_SAMPLE
oracle("content_key_partial", "doc", f"""
SELECT {DOC}, file_size || '_' || left(sha256(array_slice(b, 1, {S})
     || CASE WHEN file_size > {2 * S} THEN array_slice(b, file_size // 2 + 1, file_size // 2 + {S}) ELSE ''::BLOB END
     || CASE WHEN file_size > {S} THEN array_slice(b, file_size - {S} + 1, file_size) ELSE ''::BLOB END), 16) AS content_key
FROM (SELECT *, encode(text) AS b FROM doc)
""")
oracle("content_key_crc", "li", f"SELECT {LINE_ORDER}, printf('%d_%08x', file_size, file_crc) AS content_key FROM li")
oracle("normalize_name", "doc li", f"""
SELECT file_path, {norm_of('file_path')} AS norm_name FROM (SELECT file_path FROM doc UNION ALL SELECT file_path FROM li)
""")
oracle("path_parts", "", f"""
SELECT page_id, {name_of('url')} AS name, regexp_replace(url, '/[^/]*$', '') AS parent,
       {stem_of('url')} AS stem, {suffix_of('url')} AS suffix FROM pages
""")
oracle("file_type", "li", f"SELECT {LINE_ORDER}, {type_of('file_path')} AS file_type FROM li")
oracle("size_text", "li", f"""
SELECT {LINE_ORDER}, {size_text_of('size', PLAN_UNITS)} AS plan_text, {size_text_of('size * 100', REPORT_UNITS)} AS report_text
FROM (SELECT *, file_size * (l_orderkey % 100000 + 1) * (l_suppkey % 100000 + 1) AS size FROM li)
""")
oracle("display_fields", "doc", f"""
SELECT {DOC}, archive || ':' || file_path AS display, left(content_key, 12) || '...' AS short_key,
       left('a_long_prefix_for_the_label_' || archive, 30) AS label, '(root)' AS folder,
       'out/photos/' || strftime(archive_mtime, '%Y/%m/') || {name_of('file_path')} AS target FROM doc
""")
oracle("propose_location", "doc", f"""
SELECT {DOC}, 'extracted/' || strftime(CASE WHEN zip_y > 1980 THEN make_timestamp(zip_y, zip_mo, zip_d, zip_h, zip_mi, 0)
   ELSE archive_mtime END, '%Y/%m/') || {name_of('file_path')} AS proposed_location FROM doc
""")
oracle("zip_dates", "doc", f"""
SELECT {DOC}, CASE WHEN zip_y > 1980 THEN make_timestamp(zip_y, zip_mo, zip_d, zip_h, zip_mi, 0) END AS zip_date FROM doc
""")
oracle("exif_dates", "doc tag1", f"""
SELECT {DOC}, CASE WHEN {suffix_of('d.file_path')} IN ('.jpg', '.jpeg', '.tiff', '.tif') AND file_size > 0 THEN
   coalesce(CASE WHEN dto IS NOT NULL THEN try_strptime(dto, '%Y:%m:%d %H:%M:%S') END,
            CASE WHEN dto IS NULL THEN try_strptime(dt, '%Y:%m:%d %H:%M:%S') END) END AS exif_date
FROM (SELECT archive, entry_ix, file_path, file_size FROM doc
      UNION ALL SELECT 'orders.zip', o_orderkey, 'order_' || o_orderkey || '.jpg', 1 FROM orders WHERE o_orderkey NOT IN (SELECT entry_ix FROM doc)) d
LEFT JOIN tag1 USING (archive, file_path)
""")
oracle("sidecar_dates", "dated", "SELECT * FROM dated")
cte("exp", "li", f"""
SELECT DISTINCT archive, try_strptime(regexp_extract(archive, '{EXPORT_PREFIX}-(\\d{{8}}T\\d{{6}})Z', 1), '%Y%m%dT%H%M%S') AS export_time FROM li
""")
oracle("export_times", "exp", "SELECT * FROM exp WHERE export_time IS NOT NULL")

# Dedup --------------------------------------------------------------------

DED = "is_duplicate, group_size, original_archive, original_path"
oracle("dedup_entries", "lded", f"SELECT {LINE_ORDER}, {DED} FROM lded")
oracle("dedup_documents", "ded", f"SELECT {DOC}, {DED} FROM ded")
oracle("incremental_two_stage", "ded", f"SELECT {DOC}, {DED} FROM ded")
oracle("dedup_content_only", "dedc", f"SELECT {DOC}, {DED} FROM dedc")
oracle("dedup_candidates", "lded", f"SELECT {LINE_ORDER}, n > 1 AS is_candidate FROM lded")
oracle("dup_groups", "ded", f"SELECT {DOC}, content_key, group_size FROM ded WHERE group_size > 1")
oracle("originals", "ded", f"SELECT {DOC}, file_path, group_size FROM ded WHERE NOT is_duplicate")
oracle("dedup_counts", "lded", """
SELECT count(DISTINCT dk) AS unique_keys, count(*) - count(DISTINCT dk) AS duplicates FROM lded
""")
oracle("directory_index", "dir", """
SELECT content_key, count(*) AS file_count, min(file_path) AS first_path FROM dir GROUP BY 1
""")

# Dates and state ----------------------------------------------------------

for name, source in [("resolve_dates", "res"), ("resolve_dates_cached", "resc"), ("resolve_dates_single", "single")]:
    oracle(name, source, f"SELECT {DOC}, file_date, date_source FROM {source}")
oracle("date_source_counts", "res", """
SELECT archive, count(*) FILTER (date_source = 'json') AS json_count, count(*) FILTER (date_source = 'exif') AS exif_count,
       count(*) FILTER (date_source = 'zip') AS zip_count, count(*) FILTER (date_source = 'fallback') AS fallback_count,
       count(*) FILTER (date_source = 'cache') AS cache_count, count(*) FILTER (file_path LIKE '%.json') AS json_members
FROM res GROUP BY 1
""")
oracle("date_cache_hits", "doc dcache", f"""
SELECT d.archive, d.entry_ix, extracted_date AS cached_date FROM doc d JOIN dcache USING (archive, file_path, file_size, file_crc)
WHERE extracted_date IS NOT NULL
""")
oracle("date_cache_upsert", "docres dcache", """
SELECT archive, file_path, file_size, file_crc, file_date AS extracted_date, TIMESTAMP '2024-07-01' AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY archive, file_path ORDER BY file_size DESC, file_crc DESC) AS r
  FROM docres WHERE date_source <> 'cache') WHERE r = 1
UNION ALL
SELECT * FROM dcache d WHERE NOT EXISTS (
  SELECT 1 FROM docres r WHERE r.date_source <> 'cache' AND r.archive = d.archive AND r.file_path = d.file_path)
""")
oracle("hash_cache_refresh", "dir hcache", """
SELECT d.root, d.file_path, d.file_size, d.mtime, coalesce(h.content_key, d.content_key) AS content_key,
       h.content_key IS NOT NULL AS reused
FROM dir d LEFT JOIN hcache h ON h.root = d.root AND h.file_path = d.file_path AND h.file_size = d.file_size
     AND abs(epoch_ms(h.mtime) - epoch_ms(d.mtime)) < 1000
""")
oracle("fresh_directories", "dir", """
SELECT root, files, newest, files = file_count AND newest < TIMESTAMP '2024-01-01' AS is_fresh
FROM (SELECT lang AS root, count(*) AS files, max(mtime) AS newest FROM dir GROUP BY 1)
JOIN (SELECT lang AS root, count(*) AS file_count FROM documents GROUP BY 1) USING (root)
""")
oracle("keys_by_size", "dir", "SELECT DISTINCT file_size, content_key FROM dir")
oracle("cache_delete", "hcache dir", """
SELECT root, file_path, file_size, 'new_' || content_key AS content_key FROM hcache WHERE file_size % 2 = 0
UNION ALL
SELECT h.root, h.file_path, h.file_size, h.content_key FROM hcache h JOIN dir d USING (root, file_path)
WHERE h.file_size % 2 <> 0 AND h.file_size = d.file_size
""")
oracle("cache_clear", "hcache dcache", """
SELECT 'en cleared: dates' AS step, (SELECT count(*) FROM (SELECT DISTINCT archive, file_path FROM dcache)) AS rows
UNION ALL SELECT 'en cleared: hashes', (SELECT count(*) FROM hcache WHERE root <> 'en')
UNION ALL SELECT 'en cleared: scans', (SELECT count(DISTINCT lang) FROM documents WHERE lang <> 'en')
UNION ALL SELECT 'all cleared: ' || t, 0 FROM (VALUES ('dates'), ('hashes'), ('scans')) v(t)
""")
oracle("incremental_ingest", "docx", "SELECT DISTINCT content_key, file_size FROM docx")

# Reports ------------------------------------------------------------------

oracle("analyze_catalog", "cat", f"SELECT {DOC}, {DED}, file_date, date_source, proposed_location FROM cat")
SUMMARY = """
SELECT count(*) AS total_files, count(DISTINCT dk) AS unique_files, count(*) - count(DISTINCT dk) AS duplicate_files,
       CAST(sum(file_size) AS BIGINT) AS total_bytes,
       CAST(coalesce(sum(file_size) FILTER (is_duplicate), 0) AS BIGINT) AS wasted_bytes,
       count(DISTINCT archive) AS archives FROM {}
"""
oracle("summary_stats", "ded", SUMMARY.format("ded"))
oracle("summary_stats_lines", "lded", SUMMARY.format("lded"))


def stats_cte(name: str, source: str) -> None:
    types = ", ".join(f"count(*) FILTER (ft = '{t}') AS n_{t}" for t in DOC_TYPES)
    cte(name, source, f"""
    SELECT archive, max(archive_mtime) AS download_date, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
           count(*) FILTER (is_duplicate) AS duplicate_files,
           CAST(coalesce(sum(file_size) FILTER (is_duplicate), 0) AS BIGINT) AS duplicate_bytes,
           count(*) FILTER (NOT is_duplicate) AS unique_files, {types},
           count(*) FILTER (is_duplicate) * 100.0::DOUBLE / count(*) AS duplicate_pct,
           bool_and(is_duplicate) AS is_all_duplicate
    FROM (SELECT *, {type_of('file_path')} AS ft FROM {source}) GROUP BY archive
    """)


stats_cte("stats", "ded")
stats_cte("lstats", "lded")
oracle("archive_stats", "stats", "SELECT * FROM stats")
oracle("archive_stats_lines", "lstats", "SELECT * FROM lstats")
oracle("archive_dup_class", "stats", """
SELECT archive, download_date, files, bytes, duplicate_bytes, duplicate_pct,
       CASE WHEN duplicate_files = files THEN 'danger' WHEN duplicate_pct >= 50 THEN 'warning' ELSE 'success' END AS dup_class,
       CASE WHEN duplicate_files = files THEN 'REDUNDANT' WHEN duplicate_pct >= 80 THEN 'Mostly duplicates' ELSE '' END AS dup_label
FROM stats
""")
oracle("redundant_archives", "stats", "SELECT archive, download_date, files, bytes FROM stats WHERE is_all_duplicate")
oracle("redundant_total", "stats", """
SELECT count(*) AS archives, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS wasted_bytes FROM stats WHERE is_all_duplicate
""")
cte("ident", "docx", """
SELECT first_value(archive) OVER w AS kept_archive, archive, download_date, files, bytes,
       count(*) OVER (PARTITION BY keys) AS group_archives, row_number() OVER w = 1 AS is_kept,
       first_value(bytes) OVER w * (count(*) OVER (PARTITION BY keys) - 1) AS wasted_bytes
FROM (SELECT archive, max(archive_mtime) AS download_date, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
             list_sort(list(DISTINCT content_key)) AS keys FROM docx GROUP BY archive)
WINDOW w AS (PARTITION BY keys ORDER BY download_date, archive)
""")
oracle("identical_archives", "ident", "SELECT * FROM ident WHERE group_archives > 1")
oracle("identical_totals", "ident", """
SELECT count(*) AS groups, CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes FROM ident WHERE group_archives > 1 AND is_kept
""")
oracle("original_locations", "ded", f"""
SELECT archive, original_archive, count(*) AS files,
       string_agg({name_of('file_path')}, '|' ORDER BY r) FILTER (r <= 10) AS first_names,
       greatest(count(*) - 10, 0) AS more_names
FROM (SELECT *, row_number() OVER (PARTITION BY archive, original_archive ORDER BY archive, entry_ix) AS r
      FROM ded WHERE archive IN (SELECT archive FROM ded GROUP BY 1 HAVING bool_and(is_duplicate)))
GROUP BY archive, original_archive
""")
oracle("type_breakdown", "li", f"""
SELECT {type_of('file_path')} AS file_type, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM li GROUP BY 1
""")
oracle("year_timeline", "lded", """
SELECT *, bytes / 1073741824.0::DOUBLE AS gib, unique_bytes / 1073741824.0::DOUBLE AS unique_gib,
       duplicate_bytes / 1073741824.0::DOUBLE AS duplicate_gib
FROM (SELECT CAST(year(file_date) AS INTEGER) AS year, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
        count(*) FILTER (NOT is_duplicate) AS unique_files,
        CAST(coalesce(sum(file_size) FILTER (NOT is_duplicate), 0) AS BIGINT) AS unique_bytes,
        count(*) FILTER (is_duplicate) AS duplicate_files,
        CAST(coalesce(sum(file_size) FILTER (is_duplicate), 0) AS BIGINT) AS duplicate_bytes
      FROM lded GROUP BY 1)
""")
oracle("month_timeline", "li", """
SELECT strftime(file_date, '%Y-%m') AS month, count(*) AS files FROM li GROUP BY 1 ORDER BY 1 DESC LIMIT 24
""")
oracle("dup_by_type", "lded", f"""
SELECT {type_of('original_path')} AS file_type, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes
FROM lded WHERE is_duplicate GROUP BY 1
""")
oracle("largest_files", "li", f"""
SELECT archive, file_path, {name_of('file_path')} AS name, {type_of('file_path')} AS file_type, file_size,
       {size_text_of('file_size', REPORT_UNITS)} AS size_text
FROM (SELECT * FROM li ORDER BY file_size DESC, {LINE_ORDER} LIMIT 20)
""")
cte("rep", "cat", f"""
SELECT archive AS archive_name, archive, entry_ix, file_path, {name_of('file_path')} AS name, left(content_key, 12) || '...' AS short_key,
       content_key, is_duplicate, CASE WHEN is_duplicate THEN original_archive || ':' || original_path ELSE '' END AS duplicate_of,
       file_date, CAST(year(file_date) AS INTEGER) AS year, strftime(archive_mtime, '%Y-%m-%d') AS download_date,
       proposed_location, {type_of('file_path')} AS file_type, file_size, {size_text_of('file_size', REPORT_UNITS)} AS size_text
FROM cat
""")
oracle("report_rows", "rep", "SELECT * FROM rep")
oracle("archives_by_date", "stats", "SELECT archive, download_date, files, bytes FROM stats")
oracle("recent_archives", "stats", """
SELECT archive, left(archive, 30) AS label, download_date, files, bytes / 1048576.0::DOUBLE AS mib
FROM stats ORDER BY download_date DESC, archive LIMIT 10
""")
PAGE = "lower(name) LIKE '%doc%' AND file_type = 'image' AND NOT is_duplicate"
oracle("browse_page", "rep", f"""
SELECT archive, file_path, file_size, size_text, file_date FROM rep WHERE {PAGE}
ORDER BY file_size DESC, archive, entry_ix LIMIT 100
""")
for after in ("browse_page_two", "browse_after"):
    oracle(after, "rep", """
SELECT archive, entry_ix, file_path, file_size FROM rep ORDER BY file_size DESC, archive, entry_ix LIMIT 100 OFFSET 200
""")
oracle("browse_count", "rep", f"""
SELECT count(*) AS files, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages FROM rep WHERE {PAGE}
""")

# Compare, diff, reconcile -------------------------------------------------

cte("firsts", "dir", "SELECT content_key, min(file_path) AS match_path FROM dir GROUP BY 1")
oracle("compare_pairs", "docx firsts", f"SELECT {DOC}, file_size, match_path FROM docx JOIN firsts USING (content_key)")
oracle("compare_only_left", "docx firsts", f"""
SELECT {DOC}, file_path, file_size FROM docx WHERE content_key NOT IN (SELECT content_key FROM firsts)
""")
oracle("compare_only_right", "docx dir", f"""
SELECT {DOC}, file_size FROM docx d WHERE NOT EXISTS (SELECT 1 FROM dir l WHERE l.content_key = d.content_key)
""")
oracle("compare_summary", "docx dir", """
SELECT (SELECT count(*) FROM docx) AS total_left, (SELECT count(*) FROM dir) AS total_right,
       count(*) FILTER (hit) AS duplicate_count, CAST(coalesce(sum(file_size) FILTER (hit), 0) AS BIGINT) AS duplicate_bytes,
       count(*) FILTER (NOT hit) AS unique_left_count, CAST(coalesce(sum(file_size) FILTER (NOT hit), 0) AS BIGINT) AS unique_left_bytes,
       (SELECT count(*) FROM dir WHERE content_key NOT IN (SELECT content_key FROM docx)) AS unique_right_count
FROM (SELECT file_size, content_key IN (SELECT content_key FROM dir) AS hit FROM docx)
""")
cte("diffed", "doc dir", "SELECT *, content_key IN (SELECT content_key FROM dir) AS present FROM doc")
oracle("diff_files", "diffed", f"SELECT {DOC}, file_path, present FROM diffed")
oracle("diff_archives", "ded dir", f"""
SELECT {DOC}, content_key IN (SELECT content_key FROM dir) AS present FROM ded WHERE NOT is_duplicate
""")
oracle("diff_summary", "diffed", """
SELECT count(*) AS source_files, CAST(sum(file_size) AS BIGINT) AS source_bytes, count(*) FILTER (present) AS present_files,
       count(*) FILTER (NOT present) AS missing_files,
       CAST(coalesce(sum(file_size) FILTER (NOT present), 0) AS BIGINT) AS missing_bytes,
       count(*) FILTER (present) * 100.0::DOUBLE / count(*) AS present_pct FROM diffed
""")
cte("folders", "diffed", f"""
SELECT regexp_replace(replace(archive, '.zip', '') || '/' || file_path, '/[^/]*$', '') AS folder, count(*) AS files,
       CAST(sum(file_size) AS BIGINT) AS bytes FROM diffed WHERE NOT present GROUP BY 1
""")
oracle("missing_by_folder", "folders", f"""
SELECT folder, files, bytes, {size_text_of('bytes', PLAN_UNITS)} AS size_text, CAST(0 AS BIGINT) AS more_folders
FROM (SELECT * FROM folders ORDER BY folder LIMIT 20)
UNION ALL
SELECT '...', 0, 0, '', count(*) - 20 FROM folders HAVING count(*) > 20
""")
oracle("diff_manifest", "diffed", "SELECT file_path AS path, file_size, content_key FROM diffed WHERE NOT present")
cte("man", "cat", """
SELECT content_key, file_size, file_crc, file_date AS date, proposed_location, archive AS source_zip,
       file_path AS source_path, group_size - 1 AS duplicate_count FROM cat WHERE NOT is_duplicate
""")
oracle("manifest", "man", "SELECT * FROM man")
oracle("manifest_read_back", "man", "SELECT * FROM man")
oracle("csv_report", "cat", """
SELECT archive AS zip_file, file_path AS file_path_in_zip, content_key AS file_hash,
       CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS is_duplicate,
       CASE WHEN is_duplicate THEN original_archive || ':' || original_path ELSE '' END AS duplicate_of,
       strftime(file_date, '%Y-%m-%d %H:%M:%S') AS extracted_date, proposed_location
FROM cat
""")
cte("recon", "man dir", """
SELECT *, CASE WHEN content_key IN (SELECT content_key FROM dir) THEN 'extracted'
    WHEN source_zip NOT IN (SELECT source || '-' || lang || '.zip' FROM documents
                            WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) THEN 'source_missing'
    ELSE 'pending' END AS status FROM man
""")
oracle("reconcile_status", "recon", "SELECT source_zip, source_path, file_crc, status FROM recon")
oracle("reconcile_summary", "recon", """
SELECT status, count(r.content_key) AS files, count(r.content_key) * 100.0::DOUBLE / (SELECT count(*) FROM recon) AS pct
FROM (VALUES ('extracted'), ('pending'), ('source_missing')) s(status) LEFT JOIN recon r USING (status) GROUP BY 1
""")
oracle("pending_by_year", "recon", """
SELECT coalesce(strftime(date, '%Y'), 'Unknown') AS year, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes
FROM recon WHERE status = 'pending' GROUP BY 1
""")
oracle("missing_sources", "recon", """
SELECT source_zip, count(*) AS files FROM recon WHERE status = 'source_missing' GROUP BY 1
""")

# Planning -----------------------------------------------------------------

cte("plan", "cat dir", """
SELECT *, NOT is_duplicate AND NOT already_present AS to_extract
FROM (SELECT *, NOT is_duplicate AND content_key IN (SELECT content_key FROM dir) AS already_present FROM cat)
""")
oracle("skip_existing", "plan", f"SELECT {DOC}, is_duplicate, already_present, to_extract FROM plan")
cte("aplan", "plan", """
SELECT *, needs_extraction = 0 AND duplicates > 0 AND already_extracted = 0 AS is_redundant,
       needs_extraction = 0 AND already_extracted > 0 AS is_fully_extracted
FROM (SELECT archive, count(*) AS total, count(*) FILTER (to_extract) AS needs_extraction,
             count(*) FILTER (already_present) AS already_extracted, count(*) FILTER (is_duplicate) AS duplicates
      FROM plan GROUP BY archive)
""")
oracle("archive_plan", "aplan", "SELECT * FROM aplan")
oracle("plan_totals", "plan", """
SELECT count(*) AS total_files, count(*) FILTER (to_extract) AS to_extract,
       CAST(coalesce(sum(file_size) FILTER (to_extract), 0) AS BIGINT) AS bytes_to_extract,
       count(*) FILTER (already_present) AS already_present, count(*) FILTER (is_duplicate) AS duplicates FROM plan
""")
cte("dele", "aplan docx", """
SELECT archive, CASE WHEN is_fully_extracted THEN 'fully_extracted' ELSE 'all_duplicates' END AS status,
       CASE WHEN is_fully_extracted THEN already_extracted ELSE duplicates END AS files, archive_bytes
FROM aplan JOIN (SELECT archive, CAST(sum(file_size) AS BIGINT) AS archive_bytes FROM docx GROUP BY 1) USING (archive)
WHERE is_fully_extracted OR is_redundant
""")
oracle("deletable_archives", "dele", "SELECT * FROM dele")
oracle("deletable_total", "dele", """
SELECT count(*) AS archives, CAST(coalesce(sum(archive_bytes), 0) AS BIGINT) AS bytes FROM dele
""")


def planned_groups(key: str, label: str, text: bool = True) -> str:
    size = f", {size_text_of('bytes', PLAN_UNITS)} AS size_text" if text else ""
    return f"""
    SELECT *{size} FROM (SELECT {key} AS {label}, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes
    FROM plan WHERE to_extract GROUP BY 1)
    """


oracle("plan_by_type", "plan", planned_groups(type_of("file_path"), "file_type"))
oracle("extraction_batches", "plan", planned_groups("archive", "archive", text=False))
oracle("extract_by_year", "plan", planned_groups("coalesce(strftime(file_date, '%Y'), 'Unknown')", "year"))
oracle("resolve_destination", "li", f"""
SELECT {LINE_ORDER}, location,
       CASE WHEN k = 0 THEN location ELSE replace(location, '.jpg', '_' || k || '.jpg') END AS destination
FROM (SELECT l.*, row_number() OVER (PARTITION BY location ORDER BY {LINE_ORDER}) - 1 + CASE WHEN t.location IS NULL THEN 0 ELSE 1 END AS k
      FROM (SELECT *, 'out/' || strftime(file_date, '%Y/%m/') || 'IMG_' || l_partkey || 'x' || l_linenumber || '.jpg' AS location FROM li) l
      LEFT JOIN (SELECT DISTINCT 'out/' || strftime(o_orderdate, '%Y/%m/') || 'IMG_' || o_custkey || 'x1.jpg' AS location FROM orders) t
      USING (location))
""")
# Wanted: part.jpg, and beside it part_0.jpg to part_49.jpg, one month a folder. part_0.jpg is no numbered name. Number n
# is passed over (k counts how many were) if fewer than n - r numbers below it were, r of part.jpg's files having come
# before the first that wants the name itself; else one of the files of part.jpg takes it.
oracle("resolve_destination_families", "li", f"""
, l AS (SELECT *, CASE WHEN l_linenumber > 3 THEN 'part' ELSE 'part_' || l_partkey % 50 END AS stem,
               'out/' || strftime(file_date, '%Y/%m/') AS folder,
               row_number() OVER (ORDER BY {LINE_ORDER}) AS o FROM li),
ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY o) AS claim FROM l),
parents AS (SELECT folder, count(*) - 1 AS many FROM l WHERE stem = 'part' GROUP BY 1),
children AS (SELECT c.folder, c.stem, CAST(substr(c.stem, 6) AS BIGINT) AS n, c.first, p.many,
                    greatest(0, (SELECT count(*) FROM l WHERE l.folder = c.folder AND l.stem = 'part' AND l.o < c.first) - 1) AS r
             FROM (SELECT folder, stem, min(o) AS first FROM l WHERE stem NOT IN ('part', 'part_0') GROUP BY 1, 2) c
             JOIN parents p ON p.folder = c.folder),
walk(folder, n, k, skipped) AS (
  SELECT folder, 0::BIGINT, 0::BIGINT, false FROM parents
  UNION ALL
  SELECT w.folder, w.n + 1, w.k + CASE WHEN c.n IS NOT NULL AND w.k < c.n - c.r THEN 1 ELSE 0 END, c.n IS NOT NULL AND w.k < c.n - c.r
  FROM walk w LEFT JOIN children c ON c.folder = w.folder AND c.n = w.n + 1 WHERE w.n < 49),
taken AS (SELECT c.folder, c.stem FROM children c JOIN walk w ON w.folder = c.folder AND w.n = c.n
          WHERE NOT w.skipped AND c.n - w.k <= c.many),
numbered AS (
  SELECT r.* EXCLUDE (claim), claim - 1 + CASE WHEN t.stem IS NULL THEN 0 ELSE 1 END AS j
  FROM ranked r LEFT JOIN taken t ON t.folder = r.folder AND t.stem = r.stem),
placed AS (
  SELECT *, CASE WHEN j > 0 AND stem = 'part'
                 THEN j + (SELECT count(*) FROM walk w WHERE w.folder = numbered.folder AND w.skipped AND w.n - w.k + 1 <= j)
                 ELSE j END AS number FROM numbered)
SELECT {LINE_ORDER}, folder || stem || '.jpg' AS location,
       folder || stem || CASE WHEN number = 0 THEN '' ELSE '_' || number END || '.jpg' AS destination, CAST(NULL AS VARCHAR) AS error
FROM placed
""")
oracle("write_library", "plan", """
SELECT archive, count(*) AS total_files, count(*) AS extracted, 0::BIGINT AS errors, CAST(sum(file_size) AS BIGINT) AS bytes_extracted
FROM plan WHERE to_extract GROUP BY 1
""")
oracle("extraction_metrics", "plan", """
SELECT count(*) FILTER (to_extract) AS extracted, CAST(coalesce(sum(file_size) FILTER (to_extract), 0) AS BIGINT) AS bytes_extracted,
       0::BIGINT AS errors, count(*) FILTER (already_present) AS already_present, count(*) FILTER (is_duplicate) AS duplicates FROM plan
""")

# Exports and sources ------------------------------------------------------

oracle("latest_export", "exp", """
SELECT count(*) AS archives, count(DISTINCT CAST(export_time AS DATE)) AS export_dates, min(export_time) AS oldest_time,
       (SELECT archive FROM exp ORDER BY export_time, archive LIMIT 1) AS oldest_archive, max(export_time) AS newest_time,
       (SELECT archive FROM exp ORDER BY export_time DESC, archive DESC LIMIT 1) AS newest_archive,
       CAST(max(export_time) AS DATE) AS next_start FROM exp
""")
oracle("exports_by_date", "exp", """
SELECT CAST(export_time AS DATE) AS export_date, count(*) AS archives FROM exp GROUP BY 1
""")
cte("zips", "doc", """
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_ix) - 1 AS entry_ix,
       file_path, file_size, zip_y, zip_mo, zip_d, content_hash, content_key
FROM (SELECT * REPLACE (replace(archive, '.zip', '') || '-' || entry_ix // 5120 || '.zip' AS archive), entry_ix AS doc_ix FROM doc)
""")
oracle("archive_scan", "zips", """
SELECT archive, entry_ix, file_path, file_size, CAST(zip_y AS INTEGER) AS zip_y, CAST(zip_mo AS INTEGER) AS zip_mo,
       CAST(zip_d AS INTEGER) AS zip_d FROM zips
""")
oracle("archive_content", "zips", "SELECT archive, entry_ix, content_hash FROM zips")
oracle("archive_blocks", "zips", """
SELECT archive, entry_ix, greatest(1, CAST(ceil(file_size / 1000.0) AS BIGINT)) AS blocks, file_size AS bytes, content_hash FROM zips
""")
oracle("extract_files", "zips", """
SELECT archive, count(*) + 1 AS total_files, count(*) AS extracted, 1 AS errors, CAST(sum(file_size) AS BIGINT) AS bytes_extracted,
       'lost.jpg: unreadable member: no member ' || count(*) AS first_errors
FROM zips GROUP BY 1
""")
oracle("extracted_content", "zips", "SELECT archive, content_key, count(*) AS files FROM zips GROUP BY ALL")
oracle("crc_key_content", "zips", "SELECT archive, entry_ix, true AS same, file_size AS bytes FROM zips")
oracle("import_new", "zips dir", """
SELECT archive, count(*) AS total_files, count(*) AS extracted, 0::BIGINT AS errors, CAST(sum(file_size) AS BIGINT) AS bytes_extracted
FROM zips WHERE content_key NOT IN (SELECT content_key FROM dir) GROUP BY 1
""")
oracle("archive_keys", "zips", "SELECT archive, entry_ix, content_key FROM zips")
oracle("directory_scan", "dir", "SELECT file_path, file_size, content_key FROM dir")
oracle("fingerprints", "dir", """
SELECT file_path, count(*) OVER (PARTITION BY content_key) AS copies,
       file_size > 0 AND count(*) OVER (PARTITION BY file_size) > 1 AS was_read FROM dir
""")
oracle("directory_hash_selected", "dir hcache", """
SELECT file_path, file_size, content_key FROM dir WHERE file_path NOT IN (SELECT file_path FROM hcache)
""")
