"""DuckDB SQL of the operators that remove repeats and link near copies, by plain comparison of everything."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_DEDUP = """
WITH bytes AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
places AS (SELECT doc_id, unnest(range(len(h) // 2)) AS p, h FROM bytes),
cut AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b, CASE WHEN p + 50 <= len(h) // 2 THEN md5(substr(h, 2 * p + 1, 100)) END AS w FROM places),
first AS (SELECT w, min(doc_id) AS d FROM cut WHERE w IS NOT NULL GROUP BY w),
flags AS (SELECT cut.doc_id, p, b, coalesce(first.d < cut.doc_id, false) AS late FROM cut LEFT JOIN first ON cut.w = first.w),
cover AS MATERIALIZED (SELECT doc_id, p, b, bool_or(late) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM flags),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM cover),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT bytes.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM bytes LEFT JOIN sums ON bytes.doc_id = sums.doc_id
"""

PATH_DEDUP = r"""
WITH lists AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS MATERIALIZED (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM lists)),
flags AS (SELECT doc_id, i, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS late FROM cut),
cover AS MATERIALIZED (SELECT doc_id, i, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM flags),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cover GROUP BY doc_id)
SELECT lists.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM lists LEFT JOIN sums ON lists.doc_id = sums.doc_id
"""

NEAR_DEDUP = (
    r"""
WITH RECURSIVE lists AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '"""
    + f"{_UPPER}', '{_LOWER}"
    + r"""'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM lists)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM lists UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT lists.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, c AS component_id, c = lists.doc_id AS kept
FROM lists JOIN least ON x = lists.doc_id LEFT JOIN sizes ON sizes.doc_id = lists.doc_id
"""
)
