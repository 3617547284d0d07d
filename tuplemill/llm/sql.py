"""DuckDB SQL for the rows of the exact operators; ``documents`` is a view."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
OP10 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM starts) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(0, 20) t(o)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS c FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(c, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
OP5 = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b),
m AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM starts),
twice AS (SELECT doc_id, i FROM m QUALIFY count(*) OVER (PARTITION BY k) > 1),
runs AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM twice),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a)::BIGINT AS gone, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(c, 0) AS n_spans,
  sha256(unhex(CASE WHEN c IS NULL THEN h ELSE array_to_string(list_transform(range(0, c + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE e[j] END) + 1, 2 * ((CASE WHEN j = c THEN length(h) // 2 ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE e[j] END)))), '') END)) AS kept_sha256
FROM b LEFT JOIN cuts USING (doc_id)
"""
