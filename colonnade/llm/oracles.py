"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in tests/llm."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g
                   FROM d, unnest(range(1, len(w) - 33)) t(i) WHERE len(w) >= 35),
             twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
             hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM g JOIN twice ON g.g = twice.g) x, unnest(range(i, i + 35)) u(p)),
             e AS (SELECT d.doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) v(p)),
             k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n
                   FROM e LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.p = e.p WHERE hit.p IS NULL GROUP BY e.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op7_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
             v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
                   FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
             sizes AS (SELECT DISTINCT n FROM v),
             g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
                   FROM (SELECT doc_id, w, n FROM d, sizes WHERE len(w) >= n) x, unnest(range(1, len(w) - n + 2)) t(i)),
             hit AS (SELECT doc_id, i, g.n, item_id FROM g JOIN v ON g.n = v.n AND g.g = v.g),
             words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) y GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
             f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT d.page_id, n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest
    """,
}
