"""DuckDB SQL for the corpus queries that SQL can express on the given tables."""

from __future__ import annotations

from .secrets import BASE, KINDS, MAX_OWNERS, MAX_REPOSITORIES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}')"


def _secrets() -> str:
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        p = pattern.replace("'", "''")
        mixed = "" if kind in BASE else " AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')"
        parts.append(f"""SELECT doc_id, owner, repo, {rank} AS rank, '{kind}' AS kind, val, start_, start_ + length(whole) AS end_ FROM (
  SELECT doc_id, owner, repo, k, wholes[k] AS whole, vals[k] AS val, CAST(sum(length(gaps[k]) + coalesce(length(wholes[k - 1]), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS start_
  FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS k FROM (SELECT doc_id, owner, repo, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS wholes, regexp_extract_all(t, '{p}', {group}) AS vals FROM d))
) WHERE whole IS NOT NULL AND length(val) >= {least}{mixed}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    joined = "coalesce(string_agg({x}, ',' ORDER BY start_, rank), '')"
    item = "kind || ':' || start_ || ':' || end_"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
s AS ({' UNION ALL '.join(parts)}),
f AS (SELECT * FROM s WHERE kind IN ({base}) OR NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind IN ({base}) AND b.start_ < s.end_ AND s.start_ < b.end_)),
n AS (SELECT val, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(0) || repo) AS n_repos FROM f GROUP BY val),
j AS (SELECT * FROM (SELECT f.*, n_owners, n_repos, n_owners <= {MAX_OWNERS} AND n_repos <= {MAX_REPOSITORIES} AS live FROM f JOIN n USING (val)) WHERE kind IN ({base}) OR live)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({item}, ',' ORDER BY start_, rank) FILTER (kind IN ({base})), '')) AS base_sha256, {joined.format(x=item)} AS spans,
  count(*) FILTER (live) AS n_live, CAST(coalesce(max(n_owners), 0) AS BIGINT) AS most_owners, CAST(coalesce(max(n_repos), 0) AS BIGINT) AS most_repositories
FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""


ORACLES = {
    "op2_secrets": _secrets(),
    "op5_substrings": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (h) WHERE m < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
e AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, e.n, item FROM e JOIN win USING (g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, CAST(q.payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM q.page_id THEN f.first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
""",
}
