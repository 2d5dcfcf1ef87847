"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

SUBSTRING = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM docs),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
again AS (SELECT windows.doc_id, windows.i FROM windows JOIN firsts USING (h) WHERE firsts.least < windows.doc_id),
covered AS (SELECT words.doc_id, words.i, words.w, max(again.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN again ON words.doc_id = again.doc_id AND words.i = again.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS nth, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
wanted AS (SELECT item, nth, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS run FROM (SELECT item, nth, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM wanted),
windows AS (SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS run FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size)),
found AS (SELECT windows.doc_id, windows.i AS p, windows.size, wanted.item, wanted.nth, windows.i - wanted.i AS diagonal FROM windows JOIN wanted ON windows.size = wanted.size AND windows.run = wanted.run),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
islands AS (SELECT doc_id, size, p, nth, diagonal, p - row_number() OVER (PARTITION BY doc_id, nth, diagonal ORDER BY p) AS island FROM found),
matches AS (SELECT doc_id, min(p) - 1 AS place, max(p) - min(p) + max(size) AS reach FROM islands GROUP BY doc_id, nth, diagonal, island),
best AS (SELECT doc_id, reach AS longest_match, place AS match_at FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reach DESC, place) = 1)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match, CAST(coalesce(match_at, -1) AS BIGINT) AS match_at
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""

SQL = {"op3_substring_dedup": SUBSTRING, "op4_decontamination": DECONTAMINATION}
