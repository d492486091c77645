"""The same results in plain SQL (DuckDB), by comparing everything with everything."""

from __future__ import annotations

from folium.llm import dart_minhash, decontamination, substring_dedup

_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {substring_dedup.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {substring_dedup.WINDOW - 1})) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
gone AS (SELECT DISTINCT g.doc_id, unnest(generate_series(i, i + {substring_dedup.WINDOW - 1})) AS place FROM g JOIN m USING (k) WHERE least < g.doc_id),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS place, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.place = words.place) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM benchmark), k AS (SELECT item_id, ws, least({decontamination.SHINGLE}, len(ws)) AS k FROM i WHERE len(ws) > 0),
item AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS run FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM k)),
size AS (SELECT item_id, count(*) AS n FROM item GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM documents),
runs AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS run FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM item) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, item_id, count(*) / max(n) AS share FROM runs JOIN item USING (k, run) JOIN size USING (item_id) GROUP BY 1, 2 HAVING count(*) / max(n) >= {decontamination.THRESHOLD}),
per AS (SELECT doc_id, count(*) AS n, list_sort(list(item_id)) AS items, max(share) AS best FROM hit GROUP BY 1)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(array_to_string(items, ','), '') AS items, round(coalesce(best, 0), 9)::DOUBLE AS containment FROM d LEFT JOIN per USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM documents),
first AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY text) AS copy_of FROM d WHERE text IS NOT NULL),
r AS (SELECT doc_id, array_to_string(ws[p:p + k - 1], ' ') AS run FROM (SELECT doc_id, ws, least({dart_minhash.SHINGLE}, len(ws)) AS k, unnest(generate_series(1, len(ws) - least({dart_minhash.SHINGLE}, len(ws)) + 1)) AS p FROM first WHERE len(ws) > 0 AND doc_id = copy_of)),
c AS (SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id, run) AS unit FROM r), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM c a JOIN c b ON a.run = b.run AND a.unit = b.unit AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE same / (x.n + y.n - same) >= {dart_minhash.THRESHOLD}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t(node, root) AS (SELECT a, a FROM u UNION SELECT t.node, u.b FROM t JOIN u ON t.root = u.a), roots AS (SELECT node, min(root) AS root FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(root, copy_of, d.doc_id) AS class_id, coalesce(copy_of, d.doc_id) AS copy_of FROM d LEFT JOIN first USING (doc_id) LEFT JOIN roots ON roots.node = copy_of
"""
