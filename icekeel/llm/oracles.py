"""SQL for what SQL can express: the n-gram join whole, and the plain parts of two other operators as queries of their own."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
 e AS (SELECT doc_id, unnest(sh) AS t FROM s), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.c >= 90 * (a.n + b.n - p.c)),
 r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x)
 SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.m) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

LICENSE_BASE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND coalesce(w[i + 2], '') = 'license') AS mit, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND coalesce(w[i + 2], '') = 'license') AS apache,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND coalesce(w[i + 2], '') = 'public' AND coalesce(w[i + 3], '') = 'license') AS gpl FROM d)
 SELECT doc_id, n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, CAST(list_min(mit || apache || gpl) AS BIGINT) AS first_word, CAST(list_max(mit || apache || gpl) AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM p"""

EDITED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
 SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(nxt, 1, n // 2)) AS edited_sha256 FROM n"""
