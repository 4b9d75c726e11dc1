"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

SQL: dict[str, str] = {
    "op1_lm_scores": f"""
        WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        p AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
              FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        one AS (SELECT b, count(*) AS n FROM p GROUP BY b),
        two AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b),
        total AS (SELECT count(*) AS n FROM p),
        s AS (SELECT p.doc_id,
                CASE WHEN p.a IS NULL THEN ln(one.n / total.n)
                     WHEN two.n >= 2 THEN ln(two.n / h.n)
                     ELSE ln(0.4) + ln(one.n / total.n) END AS v
              FROM p JOIN one ON p.b = one.b CROSS JOIN total
              LEFT JOIN two ON p.a = two.a AND p.b = two.b LEFT JOIN one h ON p.a = h.b)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(t.v, 0), 4) AS log_score,
               CASE WHEN len(d.w) > 0 THEN round(t.v / len(d.w), 6) END AS mean_log_score
        FROM d LEFT JOIN (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id) t ON d.doc_id = t.doc_id""",
    "op2_decontamination": f"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM win),
        g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes)),
        hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n
                    FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit,
               coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
               coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""",
    "op11_warc_capture_index": """
        WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest FROM pages),
        h AS (SELECT payload_digest, max(page_id) AS head FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest),
        m AS (SELECT q.*, h.head, h.head IS NOT NULL AND (q.page_id IS NULL OR q.page_id < h.head) AS revisit
              FROM q LEFT JOIN h ON q.payload_bytes >= 1000 AND q.payload_digest = h.payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN head END AS refers_to
        FROM m""",
}
