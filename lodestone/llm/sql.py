"""SQL of operators whose exact result DuckDB can give at small scale."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM lists),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (total - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, b.y FROM reach JOIN both_ways b ON b.x = reach.r),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM lists JOIN comp ON comp.d = doc_id
"""

OP7_SQL = f"""
WITH dw AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
iw AS (SELECT item_id, {WORDS.format(LOWER)} AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS n, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s, unnest(range(0, len(ws) - 4)) AS pos FROM dw WHERE len(ws) >= 5),
its AS (SELECT item_id, len(ws) AS n, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s, unnest(range(0, len(ws) - 4)) AS pos FROM iw WHERE len(ws) >= 5),
iset AS (SELECT DISTINCT item_id, s, strlen(s) - 4 AS weight FROM its),
isum AS (SELECT item_id, sum(weight) AS total FROM iset GROUP BY item_id),
diagonal AS (SELECT DISTINCT d.doc_id, d.n AS dn, i.item_id, i.n, d.pos - i.pos AS diag FROM ds d JOIN its i USING (s)),
starts AS (SELECT DISTINCT doc_id, item_id, n, greatest(0, least(diag + k, dn - 5)) AS start FROM diagonal, (SELECT unnest(range(-8, 9)) AS k) WHERE abs(k) <= (n + 7) // 8),
win AS (SELECT DISTINCT w.doc_id, w.item_id, w.start, d.s, strlen(d.s) - 4 AS weight FROM starts w JOIN ds d ON d.doc_id = w.doc_id AND d.pos BETWEEN w.start AND w.start + w.n - 5),
sums AS (SELECT win.doc_id, win.item_id, win.start, sum(win.weight) AS own, coalesce(sum(win.weight) FILTER (iset.s IS NOT NULL), 0) AS common FROM win LEFT JOIN iset ON iset.item_id = win.item_id AND iset.s = win.s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, common::DOUBLE / (own + total - common) AS similarity FROM sums JOIN isum USING (item_id)),
short AS (SELECT doc_id, item_id, list_contains(list_transform(range(1, greatest(1, len(d.ws) - len(i.ws) + 2)), lambda k: d.ws[k:k + len(i.ws) - 1]), i.ws) AS has,
  list_position(list_transform(range(1, greatest(1, len(d.ws) - len(i.ws) + 2)), lambda k: d.ws[k:k + len(i.ws) - 1]), i.ws) - 1 AS start FROM (SELECT * FROM iw WHERE len(ws) BETWEEN 1 AND 4) i JOIN dw d ON true),
best AS (SELECT * FROM scored WHERE similarity + 1e-12 >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1)
SELECT doc_id, item_id, round(similarity, 9) AS similarity, start AS start_word, least(len(iw.ws), len(dw.ws) - start) AS n_words FROM best JOIN iw USING (item_id) JOIN dw USING (doc_id)
UNION ALL SELECT doc_id, item_id, 1.0 AS similarity, start AS start_word, len(iw.ws) AS n_words FROM short JOIN iw USING (item_id) WHERE has
"""
