"""SQL for DuckDB that gives the rows of the pN_ queries that SQL can express."""

from __future__ import annotations

PAGE = "page_once AS (SELECT * FROM page QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC) = 1)"
LINE = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))"
LINES = f"""{PAGE},
b AS (SELECT page_id, site, text, unnest(blocks) AS blk, generate_subscripts(blocks, 1) - 1 AS block_pos FROM page_once WHERE text IS NOT NULL),
s AS (SELECT page_id, site, block_pos, string_split(blk.text, chr(10)) AS ls FROM b),
l AS (SELECT page_id, site, block_pos, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_pos FROM s),
n AS (SELECT page_id, site, block_pos, line_pos, {LINE} AS norm FROM l)"""


SETS = rf"""{PAGE},
v AS (SELECT DISTINCT page_id, 'headings' AS field, trim(regexp_replace(lower(h.text), '\s+', ' ', 'g')) AS v FROM (SELECT page_id, unnest(headings) AS h FROM page_once) WHERE trim(regexp_replace(lower(h.text), '\s+', ' ', 'g')) <> ''
      UNION ALL
      SELECT DISTINCT page_id, 'text' AS field, lower(w) AS v FROM (SELECT page_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM page_once) WHERE length(lower(w)) >= 3 AND NOT regexp_full_match(w, '\p{{Nd}}+')),
c AS (SELECT field, page_id, count(*) AS n, md5(string_agg(v, chr(10) ORDER BY v)) AS whole FROM v GROUP BY ALL HAVING count(*) >= CASE field WHEN 'text' THEN 100 ELSE 6 END),
m AS (SELECT field, page_id, n, min(page_id) OVER (PARTITION BY field, whole) AS class_id FROM c),
k AS (SELECT v.field, v.page_id, v.v, m.n FROM v JOIN m ON v.field = m.field AND v.page_id = m.page_id WHERE m.class_id = m.page_id),
pr AS (SELECT a.field, a.page_id AS a, b.page_id AS b FROM k a JOIN k b ON a.field = b.field AND a.v = b.v AND a.page_id < b.page_id
  GROUP BY ALL HAVING count(*) >= CASE a.field WHEN 'text' THEN 0.75 ELSE 0.6 END * max(greatest(a.n, b.n)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_text": f"""WITH {LINES},
t AS (SELECT site, count(*) AS pages FROM page_once WHERE text IS NOT NULL GROUP BY site),
r AS (SELECT n.site, norm FROM n JOIN t USING (site) WHERE norm <> '' GROUP BY n.site, norm, t.pages
      HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) >= 0.1 * t.pages),
k AS (SELECT l.page_id, l.block_pos, string_agg(l.line, chr(10) ORDER BY l.line_pos) AS text FROM l JOIN n USING (page_id, block_pos, line_pos) ANTI JOIN r ON r.site = n.site AND r.norm = n.norm GROUP BY l.page_id, l.block_pos),
w AS (SELECT page_id, string_agg(text, chr(10) ORDER BY block_pos) AS text, count(*) AS n FROM k GROUP BY page_id)
SELECT p.page_id, CASE WHEN p.text IS NOT NULL THEN coalesce(w.text, '') END AS text, CAST(CASE WHEN p.text IS NOT NULL THEN coalesce(w.n, 0) ELSE coalesce(len(p.blocks), 0) END AS INT) AS blocks_left FROM page_once p LEFT JOIN w USING (page_id)""",
        "p3_classes": f"""WITH {SETS}, e AS (SELECT field, a AS class_id FROM pr UNION ALL SELECT field, b FROM pr), d AS (SELECT field, class_id, count(*) AS links FROM e GROUP BY ALL)
SELECT m.field, page_id, m.class_id, coalesce(links, 0) AS links FROM m LEFT JOIN d ON d.field = m.field AND d.class_id = m.class_id""",
        "p1_found": f"""WITH {LINES},
t AS (SELECT site, count(*) AS pages FROM page_once WHERE text IS NOT NULL GROUP BY site),
r AS (SELECT n.site, norm FROM n JOIN t USING (site) WHERE norm <> '' GROUP BY n.site, norm, t.pages
      HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) >= 0.1 * t.pages)
SELECT page_id, CAST(block_pos AS INT) AS block_pos, CAST(line_pos AS INT) AS line_pos FROM n JOIN r USING (site, norm)""",
        "p2_found": rf"""WITH {PAGE},
w AS (SELECT page_id, lower(unnest(regexp_extract_all(concat_ws(' ', title, text), '[\p{{L}}\p{{N}}]+'))) AS term FROM page_once),
f AS (SELECT page_id, term, count(*) AS tf FROM w WHERE regexp_full_match(term, '[a-z]{{7,}}') GROUP BY ALL),
d AS (SELECT term FROM f GROUP BY term HAVING count(*) BETWEEN 2 AND 6)
SELECT page_id, term FROM f JOIN d USING (term) WHERE tf >= 4""",
        "p2_scores": rf"""WITH {PAGE},
w AS (SELECT page_id, lower(unnest(regexp_extract_all(concat_ws(' ', title, text), '[\p{{L}}\p{{N}}]+'))) AS term FROM page_once),
f AS (SELECT page_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT page_id, count(*) AS len FROM w GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT page_id, term, tf, df, CAST(tf AS DOUBLE) / len * (ln((1.0 + (SELECT count(*) FROM page_once)) / (1.0 + df)) + 1.0) AS score FROM f JOIN n USING (page_id) JOIN d USING (term)""",
        "p3_found": rf"""WITH {PAGE},
v AS (SELECT DISTINCT page_id, 'headings' AS field, trim(regexp_replace(lower(h.text), '\s+', ' ', 'g')) AS v FROM (SELECT page_id, unnest(headings) AS h FROM page_once) WHERE trim(regexp_replace(lower(h.text), '\s+', ' ', 'g')) <> ''
      UNION ALL
      SELECT DISTINCT page_id, 'text' AS field, lower(w) AS v FROM (SELECT page_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM page_once) WHERE length(lower(w)) >= 3 AND NOT regexp_full_match(w, '\p{{Nd}}+')),
c AS (SELECT field, page_id, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= CASE field WHEN 'text' THEN 100 ELSE 6 END),
k AS (SELECT v.field, v.page_id, v.v, c.n FROM v JOIN c ON v.field = c.field AND v.page_id = c.page_id)
SELECT a.field, a.page_id AS page_a, b.page_id AS page_b FROM k a JOIN k b ON a.field = b.field AND a.v = b.v AND a.page_id < b.page_id
GROUP BY ALL HAVING count(*) >= CASE a.field WHEN 'text' THEN 0.75 ELSE 0.6 END * max(greatest(a.n, b.n))""",
        "p10_found": rf"""WITH
w AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '[0-9]+', '0', 'g'), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 50),
r AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, array_to_string(ws[i:i+5], ' ') ORDER BY i) AS k FROM g),
p AS (SELECT DISTINCT doc_id, n, i + j AS at FROM (SELECT doc_id, n, i, unnest(range(6)) AS j FROM r WHERE k > 1))
SELECT doc_id FROM p GROUP BY doc_id, n HAVING count(*) >= 0.3 * n""",
    }
