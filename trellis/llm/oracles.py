"""DuckDB SQL for the rows of the queries that SQL can express: brute force, each by a way of its own.

Sharding needs CRC-32 and tokenizers ranked merges, which DuckDB has not; the rest are models. Tests compare those with plain Python."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, (5 * (i // 4) + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM d"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, text FROM documents),
nodes AS MATERIALIZED (SELECT text, row_number() OVER (ORDER BY text) AS node, min(doc_id) AS least_id, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY text),
words AS (SELECT node, regexp_extract_all(text, {_SPACED}) AS w FROM nodes),
places AS (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
counts AS MATERIALIZED (SELECT node, array_to_string(w[i:i + 4], ' ') AS shingle, count(*) AS c FROM places GROUP BY ALL),
sizes AS (SELECT node, sum(c) AS size FROM counts GROUP BY node),
shared AS (SELECT a.node AS x, b.node AS y, sum(least(a.c, b.c)) AS s FROM counts a JOIN counts b ON a.shingle = b.shingle AND a.node < b.node GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.node = x JOIN sizes q ON q.node = y WHERE 5 * s >= 4 * (p.size + q.size - s)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other),
roots AS MATERIALIZED (SELECT node, min(other) AS root FROM reach GROUP BY node),
classes AS (SELECT root, min(least_id) AS class_id, sum(n) AS class_rows FROM roots JOIN nodes USING (node) GROUP BY root)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE class_id END AS class_id, CASE WHEN d.text IS NULL THEN 1 ELSE class_rows END::BIGINT AS class_rows
FROM d LEFT JOIN nodes USING (text) LEFT JOIN roots USING (node) LEFT JOIN classes USING (root)"""

DECONTAMINATION = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM starts),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
hits AS MATERIALIZED (SELECT r, i, p.k, item_id FROM places p JOIN windows v ON v.k = p.k AND v.words = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)"""

#: Kind, regex of a match, and how many characters its group must have. Letters in either case are classes, as `(?i)` of some libraries folds beyond A to Z.
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
)
#: Of each kind: the texts before, of, and in the group of every match, side by side.
_MATCHES = "\nUNION ALL ".join(
    f"SELECT r, {i} AS kind_no, '{kind}' AS kind, {least} AS least, unnest(range(1, len(whole) + 1)) AS i, unnest(gaps[1:len(whole)]) AS gap, unnest(whole) AS m, unnest(grp) AS g\n"
    f"FROM (SELECT r, regexp_split_to_array(text, '{regex}') AS gaps, regexp_extract_all(text, '{regex}', 0) AS whole, regexp_extract_all(text, '{regex}', {group}) AS grp FROM docs)"
    for i, (kind, regex, group, least) in enumerate(_SECRETS)
)
SECRETS = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({_MATCHES}),
spans AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind_no ORDER BY i) AS stop FROM matches),
held AS (SELECT r, kind_no, kind, stop - length(m) AS start, concat_ws(':', kind, (stop - length(m))::BIGINT::VARCHAR, stop::BIGINT::VARCHAR) AS span FROM spans WHERE length(g) >= least),
joined AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM held GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (r)"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc": WARC,
    "op5_minhash_dedup": NEAR,
    "op6_secret_scan": SECRETS,
    "op9_decontamination": DECONTAMINATION,
}
