"""SQL for DuckDB that gives the rows of the queries, written apart from their DataFrame form."""

from __future__ import annotations

from corpusmill.functions import passages as P
from corpusmill.functions.text import ACCENTED, PLAIN, STOP
from corpusmill.functions.urls import ASSET_ENDINGS, TRACKING
from corpusmill.operators.access import ANSWERING, TRAINING
from corpusmill.operators.links import EMPTY_ANCHOR, WEAK_ANCHORS
from corpusmill.operators.quotability import ENTITY_HOSTS


def _quote(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


#: White space and letters as Unicode has them, for a dialect whose classes are ASCII.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = r"[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])"

PAGE = "pg AS (SELECT * FROM page WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
ELIGIBLE = "el AS (SELECT * FROM pg WHERE status = 200 AND coalesce(words, 0) >= 40 AND NOT contains(coalesce(robots_meta, ''), 'noindex'))"


def _tokens(x: str) -> str:
    return (
        f"list_filter(string_split_regex(lower(translate({x}, '’''', '  ')), '[^a-zà-öø-ÿ0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') "
        f"AND NOT list_contains([{_quote(sorted(STOP))}], translate(w, '{ACCENTED}', '{PLAIN}')))"
    )


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _count_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


DOCS = f"""{PAGE}, {ELIGIBLE},
docs AS (SELECT site, page_id, url, coalesce(title, '') || ' ' || coalesce(array_to_string(list_transform(headings, lambda h: coalesce(h.text, '')), ' '), '') || ' ' || coalesce(text, '') AS doc FROM el)"""
TF = f"""{DOCS},
tk AS (SELECT site, page_id, {_tokens("doc")} AS t FROM docs),
un AS (SELECT site, page_id, 2 * len(t) - 1 AS total, unnest(t) AS term, false AS is_bigram, generate_subscripts(t, 1) - 1 AS pos FROM tk),
bg AS (SELECT site, page_id, total, unnest(b) AS term, true AS is_bigram, generate_subscripts(b, 1) - 1 AS pos FROM (SELECT site, page_id, 2 * len(t) - 1 AS total, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM tk)),
tf AS (SELECT site, page_id, term, is_bigram, CAST(min(pos) AS INT) AS first_pos, count(*) AS f, total FROM (SELECT * FROM un UNION ALL SELECT * FROM bg) GROUP BY site, page_id, term, is_bigram, total)"""
VECTORS = f"""{TF},
dn AS (SELECT site, count(*) AS n FROM docs GROUP BY site),
df AS (SELECT site, term, count(*) AS df FROM tf GROUP BY ALL),
wt AS (SELECT tf.*, CAST(f AS DOUBLE) / total * ln(1 + CAST(n AS DOUBLE) / (1 + df)) AS w FROM tf JOIN df USING (site, term) JOIN dn USING (site) WHERE n >= 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(w, 12) DESC, is_bigram, first_pos) AS rk FROM wt QUALIFY rk <= 80),
vc AS MATERIALIZED (SELECT site, page_id, term, CAST(rk AS INT) AS rk, w / coalesce(nullif(sqrt(sum(w * w) OVER (PARTITION BY page_id)), 0), 1) AS weight FROM tp)"""
PAIRS = f"""{VECTORS},
rare AS (SELECT v.* FROM vc v JOIN (SELECT site, term FROM vc GROUP BY ALL HAVING count(*) <= 60) USING (site, term)),
cd AS MATERIALIZED (SELECT x.site, x.page_id AS a, y.page_id AS b, count(*) AS shared FROM rare x JOIN rare y ON x.site = y.site AND x.term = y.term AND x.page_id < y.page_id GROUP BY ALL HAVING count(*) >= 2),
both_ AS (SELECT cd.site, cd.a, cd.b, x.term, x.weight + y.weight AS ws, x.weight * y.weight AS wp, x.rk FROM cd JOIN vc x ON x.page_id = cd.a JOIN vc y ON y.page_id = cd.b AND y.term = x.term),
pr AS MATERIALIZED (SELECT site, a, b, sum(wp) AS similarity, array_to_string(list(term ORDER BY round(ws, 12) DESC, rk)[1:5], ', ') AS terms FROM both_ GROUP BY ALL HAVING sum(wp) >= 0.30)"""
LINKS = """lk AS (SELECT site, page_id, source, status, pos, l.target AS raw, coalesce(l.anchor, '') AS anchor, coalesce(l.boilerplate, false) AS tagged, coalesce(l.internal, false) AS internal, coalesce(l.asset, false) AS asset, coalesce(l.nofollow, false) AS nofollow
  FROM (SELECT site, page_id, url AS source, status, unnest(links) AS l, generate_subscripts(links, 1) - 1 AS pos FROM pg)),
al AS (SELECT site, raw, url AS target FROM (
    SELECT site, url, page_id, 0 AS kind, url AS raw FROM pg UNION ALL SELECT site, url, page_id, 1, final_url FROM pg WHERE final_url <> ''
    UNION ALL SELECT site, url, page_id, 1 + generate_subscripts(redirects, 1), unnest(redirects) FROM pg)
  WHERE raw IS NOT NULL AND raw <> '' QUALIFY row_number() OVER (PARTITION BY site, raw ORDER BY kind > 0, page_id, kind) = 1),
oc AS (SELECT site, raw, lower(anchor) AS low, count(DISTINCT page_id) AS pages FROM lk WHERE internal GROUP BY ALL),
sz AS (SELECT site, greatest(count(*) FILTER (status = 200), 1) AS pages_200 FROM pg GROUP BY site),
fq AS (SELECT site, raw, low FROM oc JOIN sz USING (site) WHERE CAST(pages AS DOUBLE) / pages_200 >= 0.60)"""
ROUTED = f"""{PAGE}, {LINKS},
rt AS MATERIALIZED (SELECT lk.site, lk.page_id, lk.source, lk.pos, lk.raw, lk.anchor, lk.nofollow, al.target, lk.tagged OR fq.low IS NOT NULL AS boilerplate,
  CASE WHEN NOT internal THEN 'external' WHEN asset THEN 'asset' WHEN al.target IS NULL AND coalesce(c.complete, true) THEN 'broken' WHEN al.target IS NULL THEN 'unverified'
       WHEN dp.status = 0 OR dp.status >= 400 THEN 'broken' ELSE 'edge' END AS outcome,
  CASE WHEN al.target IS NULL THEN 'target missing' ELSE 'HTTP ' || dp.status END AS why, CASE WHEN len(dp.redirects) > 0 THEN coalesce(dp.final_url, '') END AS moved
  FROM lk LEFT JOIN al ON al.site = lk.site AND al.raw = lk.raw LEFT JOIN pg dp ON dp.site = lk.site AND dp.url = al.target
  LEFT JOIN fq ON fq.site = lk.site AND fq.raw = lk.raw AND fq.low = lower(lk.anchor) LEFT JOIN corpus c ON c.site = lk.site WHERE lk.status = 200),
ed AS (SELECT site, source, target, anchor, boilerplate, nofollow FROM rt WHERE outcome = 'edge')"""
HOME = "hm AS (SELECT site, url FROM pg QUALIFY row_number() OVER (PARTITION BY site ORDER BY url <> site, length(url), page_id) = 1)"
DEGREES = f"""{ROUTED}, {HOME},
ib AS (SELECT site, target AS url, count(*) AS inbound, count(*) FILTER (NOT boilerplate) AS inbound_editorial FROM ed WHERE NOT nofollow GROUP BY ALL),
ob AS (SELECT site, source AS url, count(*) AS outbound_editorial FROM ed WHERE NOT boilerplate GROUP BY ALL),
dg AS (SELECT site, url, CAST(coalesce(words, 0) AS BIGINT) AS words, coalesce(inbound, 0) AS inbound, coalesce(inbound_editorial, 0) AS inbound_editorial, coalesce(outbound_editorial, 0) AS outbound_editorial
  FROM pg LEFT JOIN ib USING (site, url) LEFT JOIN ob USING (site, url) WHERE status = 200)"""
SECTION = r"coalesce('/' || nullif(regexp_extract(regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '^/*([^/]+)', 1), ''), '/(root)')"
HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[^:\]]*$', ''))"
DEPTH = """fe AS (SELECT DISTINCT site, source, target FROM ed WHERE NOT nofollow),
wk(site, url, depth) AS (SELECT site, url, 0 FROM hm UNION SELECT fe.site, fe.target, wk.depth + 1 FROM wk JOIN fe ON fe.site = wk.site AND fe.source = wk.url WHERE wk.depth < 60),
dp AS (SELECT site, url, min(depth) AS depth FROM wk GROUP BY ALL)"""
PAGE_DEPTH = f"WITH RECURSIVE {DEGREES}, {DEPTH}, pd AS (SELECT pg.site, pg.url, CAST(coalesce(dp.depth, 99) AS INT) AS depth FROM pg LEFT JOIN dp USING (site, url) WHERE status = 200)"
RANK = f"""WITH RECURSIVE {ROUTED},
nd AS (SELECT site, url FROM pg WHERE status = 200), nn AS (SELECT site, count(*) AS n FROM nd GROUP BY site),
pe AS (SELECT DISTINCT e.site, source, target FROM ed e JOIN nd a ON a.site = e.site AND a.url = e.source JOIN nd b ON b.site = e.site AND b.url = e.target WHERE NOT nofollow AND source <> target),
og AS (SELECT site, source, count(*) AS k FROM pe GROUP BY ALL),
base AS (SELECT nd.site, nd.url, n, k FROM nd JOIN nn USING (site) LEFT JOIN og ON og.site = nd.site AND og.source = nd.url),
pk(i, site, url, n, k, r) AS (SELECT 0, site, url, n, k, 1.0::DOUBLE / n FROM base
  UNION ALL SELECT i + 1, site, url, any_value(n), any_value(k), sum(g) FROM (
    SELECT p.i, p.site, p.url, p.n, p.k, 0.15::DOUBLE / p.n + 0.85::DOUBLE * sum(CASE WHEN p.k IS NULL THEN p.r ELSE 0 END) OVER (PARTITION BY p.site) / p.n AS g FROM pk p WHERE p.i < 40
    UNION ALL SELECT p.i, t.site, t.url, t.n, t.k, 0.85::DOUBLE * p.r / p.k FROM pk p JOIN pe ON pe.site = p.site AND pe.source = p.url JOIN base t ON t.site = pe.site AND t.url = pe.target WHERE p.i < 40)
  GROUP BY i, site, url),
rk AS (SELECT site, url, r AS rank FROM pk WHERE i = 40)"""
ANCHORS = f"""{ROUTED},
ea AS (SELECT site, source, target, {_strip("anchor")} AS anchor FROM ed WHERE NOT boilerplate),
ak AS (SELECT *, trim(lower(anchor), ' .:!?"''') AS key FROM ea)"""
QUOTABLE = "qe AS (SELECT * FROM pg WHERE status = 200 AND coalesce(words, 0) >= 40)"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(tx, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
PASSAGES = f"""{PAGE}, {QUOTABLE},
bk AS (SELECT site, page_id, url, pos, coalesce(b.heading, '') AS heading, {_strip("coalesce(b.text, '')")} AS tx FROM (SELECT site, page_id, url, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS pos FROM qe)),
b2 AS (SELECT *, {_count_words("tx")} AS n, {_SENTENCES} AS ss, len(regexp_extract_all(regexp_replace(tx, '[À-ɏͰ-ԯ]', '_', 'g'), '\\b\\d+([.,]\\d+)?{WS}?({P.UNITS.replace("\\$", "[$]")})?\\b')) AS fg FROM bk WHERE {_count_words("tx")} >= 25),
b3 AS (SELECT *, coalesce(ss[1], '') AS first_, heading <> '' AND regexp_matches(heading, '(?i)^{WS}*({_sql(P.QUESTIONS)})') AS asks, regexp_matches(array_to_string(ss[1:2], ' '), '(?i){EDGE_L}({P.DEFINITIONS}){EDGE_R}') AS defines FROM b2),
b4 AS (SELECT *, defines OR (first_ <> '' AND {_count_words("first_")} <= 35) AS answers, regexp_matches(first_, '(?i)^{WS}*({_sql(P.CARRYING)}){EDGE_R}') AS carries FROM b3),
ps AS MATERIALIZED (SELECT site, page_id, url, CAST(pos AS INT) AS pos, heading, CAST(n AS INT) AS words,
  CAST(CASE WHEN n BETWEEN 60 AND 220 THEN 2 WHEN n BETWEEN 40 AND 320 THEN 1 ELSE 0 END + asks::INT + answers::INT + (NOT carries)::INT + (fg >= 2)::INT AS INT) AS score,
  coalesce(array_to_string([CASE WHEN n BETWEEN 60 AND 220 THEN NULL WHEN n BETWEEN 40 AND 320 THEN '{P.UNCOMFORTABLE}' WHEN n < 40 THEN n || ' words: too short to stand alone' ELSE n || ' words: too long to be lifted as-is' END,
    CASE WHEN heading = '' THEN '{P.NO_HEADING}' WHEN NOT asks THEN '{P.NO_QUESTION}' END, CASE WHEN NOT answers THEN '{P.NO_ANSWER}' END, CASE WHEN carries THEN '{P.CARRIES}' END, CASE WHEN fg < 2 THEN '{P.NO_FIGURES}' END], '; '), '') AS gaps FROM b4)"""
_DATE = _sql(rf"(?i){EDGE_L}(\d{{1,2}}{WS}+({P.MONTHS}){WS}+\d{{4}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}){EDGE_R}")
_BYLINE = _sql(rf"(?i){EDGE_L}({P.BYLINES}){WS}+[A-ZÉÈÀÂÎÔÛ][\p{{L}}\p{{N}}\p{{M}}_'’-]+")
JSONLD = f"""{PAGE}, {QUOTABLE},
js AS (SELECT site, page_id, url, TRY_CAST(j AS JSON) AS j FROM (SELECT site, page_id, url, unnest(jsonld) AS j FROM qe)),
r0 AS (SELECT site, page_id, url, j AS o FROM js WHERE json_type(j) = 'OBJECT' UNION ALL SELECT site, page_id, url, unnest(json_extract(j, '$[*]')) FROM js WHERE json_type(j) = 'ARRAY'),
r1 AS (SELECT * FROM r0 UNION ALL SELECT site, page_id, url, unnest(CASE WHEN json_type(o, '$."@graph"') = 'ARRAY' THEN json_extract(o, '$."@graph"[*]') ELSE [json_extract(o, '$."@graph"')] END) FROM r0 WHERE json_exists(o, '$."@graph"')),
ob AS (SELECT * FROM r1 WHERE json_exists(o, '$."@type"'))"""
_DESCRIBED = f"""WITH {PAIRS},
ea AS (SELECT site, url AS source, unnest(links) AS l FROM pg),
a1 AS (SELECT site, raw, url AS target FROM (SELECT site, url, page_id, 0 AS kind, url AS raw FROM pg UNION ALL SELECT site, url, page_id, 1, final_url FROM pg WHERE final_url <> '') QUALIFY row_number() OVER (PARTITION BY site, raw ORDER BY kind, page_id) = 1),
lp AS (SELECT DISTINCT ea.site, least(source, target) AS a, greatest(source, target) AS b FROM ea JOIN a1 ON a1.site = ea.site AND a1.raw = ea.l.target WHERE ea.l.internal AND NOT coalesce(ea.l.boilerplate, false)),
dc AS (SELECT pr.site, x.url AS url_a, y.url AS url_b, coalesce(x.title, '') AS title_a, coalesce(y.title, '') AS title_b, lp.a IS NOT NULL AS linked, similarity AS s, terms,
  lower(string_split(translate(coalesce(x.lang, ''), '_', '-'), '-')[1]) AS la, lower(string_split(translate(coalesce(y.lang, ''), '_', '-'), '-')[1]) AS lb
  FROM pr JOIN pg x ON x.page_id = pr.a JOIN pg y ON y.page_id = pr.b LEFT JOIN lp ON lp.site = pr.site AND lp.a = least(x.url, y.url) AND lp.b = greatest(x.url, y.url))
SELECT site, url_a, url_b, title_a, title_b, linked, round(s, 3) AS similarity, terms FROM dc WHERE """
H1 = "coalesce(list_filter(headings, lambda h: h.level = 1)[1].text, '')"
ISSUES = f"""CASE WHEN len(h1s) = 0 THEN 'no H1' WHEN len(h1s) > 1 THEN len(h1s) || ' H1s' END,
  CASE WHEN sk IS NOT NULL THEN 'skips H' || lv[sk] || '→H' || lv[sk + 1] END, CASE WHEN em > 0 THEN em || ' empty heading(s)' END"""
HEADINGS = f"""hd AS (SELECT *, list_filter(lv, lambda x: x = 1) AS h1s, list_filter(range(1, len(lv)), lambda i: lv[i] > 0 AND lv[i + 1] > lv[i] + 1)[1] AS sk
  FROM (SELECT *, coalesce(list_transform(headings, lambda h: h.level), []) AS lv, len(list_filter(coalesce(headings, []), lambda h: {_strip("coalesce(h.text, '')")} = '')) AS em FROM el)),
hi AS (SELECT *, coalesce(array_to_string([{ISSUES}], ', '), '') AS issues FROM hd)"""
CARDS = f"""{VECTORS}, {HEADINGS},
tt AS (SELECT page_id, list(term ORDER BY rk) AS terms FROM vc WHERE rk <= 8 GROUP BY page_id),
ca AS (SELECT site, url, CAST(words AS BIGINT) AS words, coalesce(title, '') AS title, {H1} AS h1, coalesce(description, '') = '' AS no_description, coalesce(terms, []) AS terms, issues, {_tokens(f"coalesce(title, '') || ' ' || {H1}")} AS named FROM hi LEFT JOIN tt USING (page_id)),
cb AS (SELECT *, list_filter(terms[1:4], lambda t: NOT contains(t, ' ') AND NOT list_contains(named, t)) AS off FROM ca)"""


def _same(value: str) -> str:
    return f"""WITH {PAGE}, {ELIGIBLE}, k AS (SELECT site, url, lower({_strip("v")}) AS key FROM (SELECT site, url, {value} AS v FROM el) WHERE v <> '')
SELECT site, key, count(*) AS n, array_to_string(list(url ORDER BY url), ' ') AS urls FROM k GROUP BY ALL HAVING count(*) > 1"""


_ENCODED = "replace(replace(url_encode({0}), '%20', '+'), '~', '~')"
PARAMETERS = r"""pp AS (SELECT url, i, url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')) AS k, url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')) AS v
  FROM (SELECT url, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM (SELECT url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM us)))"""


def oracle_sql() -> dict[str, str]:
    out = {
        "tokenize_documents": f"WITH {DOCS} SELECT site, url, array_to_string({_tokens('doc')}, ' ') AS tokens FROM docs",
        "term_frequency": f"WITH {TF} SELECT * FROM tf",
        "document_frequency": f"WITH {TF} SELECT site, term, count(*) AS df FROM tf GROUP BY ALL",
        "tfidf_top80": f"WITH {VECTORS} SELECT * FROM vc",
        "lexical_field": f"WITH {VECTORS}, lx AS (SELECT site, term, sum(weight) AS weight FROM vc GROUP BY ALL) SELECT site, term, weight, CAST(row_number() OVER (PARTITION BY site ORDER BY round(weight, 9) DESC, term) AS INT) AS rk FROM lx QUALIFY rk <= 25",
        "candidate_pairs": f"WITH {PAIRS} SELECT site, a, b, shared FROM cd",
        "cosine_pairs": f"WITH {PAIRS} SELECT site, a, b, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.95 THEN 'same' WHEN similarity >= 0.7 THEN 'cannibalisation' WHEN similarity >= 0.5 THEN 'overlap' ELSE 'complementary' END AS band FROM pr",
        "shared_terms": f"WITH {PAIRS} SELECT site, a, b, terms FROM pr",
        "opportunities": _DESCRIBED + "s < 0.70 AND NOT linked",
        "cannibalisation": _DESCRIBED + "s >= 0.70 AND s < 0.95",
        "cannibalisation_one_language": _DESCRIBED + "s >= 0.70 AND s < 0.95 AND la = lb",
        "duplicates": f"""WITH RECURSIVE {PAIRS}, sm AS (SELECT a, b FROM pr WHERE similarity >= 0.95 UNION SELECT b, a FROM pr WHERE similarity >= 0.95),
rc(x, y) AS (SELECT a, a FROM sm UNION SELECT rc.x, sm.b FROM rc JOIN sm ON sm.a = rc.y), lb AS (SELECT x AS page_id, min(y) AS label FROM rc GROUP BY x)
SELECT site, array_to_string(list(url ORDER BY length(url), url), ' ') AS urls, coalesce(array_to_string(list_sort(list_distinct(list(canonical) FILTER (canonical <> ''))), ' '), '') AS canonicals, arg_min(coalesce(title, ''), (length(url), url)) AS title
FROM lb JOIN pg USING (page_id) GROUP BY site, label""",
        "neighbours": f"WITH {PAIRS} SELECT site, page_id, count(*) AS neighbours FROM (SELECT site, a AS page_id FROM pr UNION ALL SELECT site, b FROM pr) GROUP BY ALL",
        "isolated": f"WITH {PAIRS} SELECT site, url FROM docs JOIN dn USING (site) WHERE n >= 2 AND page_id NOT IN (SELECT a FROM pr UNION ALL SELECT b FROM pr)",
        "page_cards": f"WITH {CARDS} SELECT site, url, words, title, h1, no_description, array_to_string(terms, ', ') AS terms, array_to_string(off, ', ') AS off_title, issues FROM cb",
        "off_title": f"WITH {CARDS} SELECT site, url, title, array_to_string(off, ', ') AS off_title FROM cb WHERE len(off) >= 3",
        "thin_content": f"WITH {PAGE}, {ELIGIBLE} SELECT site, url, CAST(words AS BIGINT) AS words FROM el WHERE words < 250",
        "heading_issues": f"WITH {PAGE}, {ELIGIBLE}, {HEADINGS} SELECT site, url, issues FROM hi WHERE issues <> ''",
        "no_description": f"WITH {PAGE}, {ELIGIBLE} SELECT site, url FROM el WHERE coalesce(description, '') = ''",
        "duplicate_titles": _same("title"), "duplicate_h1": _same(H1), "duplicate_descriptions": _same("description"),
        "url_normalise": rf"""WITH {PAGE}, us AS (SELECT DISTINCT url FROM (SELECT url FROM pg UNION ALL SELECT l.target FROM (SELECT unnest(links) AS l FROM pg))), {PARAMETERS},
qs AS (SELECT url, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS q FROM pp WHERE NOT regexp_matches(k, '(?i)^({TRACKING})') GROUP BY url),
ps AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) AS sc, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', '') AS au, regexp_replace(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/{{2,}}', '/', 'g') AS pa FROM us)
SELECT url, coalesce(nullif(lower(sc), ''), 'https') || '://' || lower(regexp_replace(au, ':[^:]*$', '')) || CASE WHEN regexp_extract(au, ':(\d+)$', 1) IN ('', '443', '80') THEN '' ELSE ':' || regexp_extract(au, ':(\d+)$', 1) END || CASE WHEN starts_with(pa, '/') THEN pa ELSE '/' || pa END || coalesce('?' || q, '') AS normalised FROM ps LEFT JOIN qs USING (url)""",
        "url_section": f"WITH {PAGE} SELECT url, {SECTION.format('url')} AS section, {HOST.format('url')} AS host FROM pg",
        "url_resolve": f"WITH {PAGE}, {LINKS} SELECT DISTINCT page_id, raw, CASE WHEN regexp_replace(raw, '^https?://[^/]*', '') = '' THEN source ELSE regexp_extract(source, '^(https?://[^/]*)', 1) || regexp_replace(raw, '^https?://[^/]*', '') END AS resolved FROM lk WHERE internal",
        "tracking_params": f"WITH {PAGE}, us AS (SELECT DISTINCT l.target AS url FROM (SELECT unnest(links) AS l FROM pg)), {PARAMETERS} SELECT url, k AS name, v AS value, regexp_matches(k, '(?i)^({TRACKING})') AS tracking FROM pp",
        "asset_flags": rf"WITH {PAGE}, {LINKS} SELECT DISTINCT raw, regexp_matches(raw, '(?i)\.({ASSET_ENDINGS})(\?|$)') AS asset, regexp_matches(lower(raw), '^https?://') AS http FROM lk",
        "same_site": rf"WITH {PAGE}, {LINKS} SELECT DISTINCT site, raw, regexp_replace({HOST.format('raw')}, '^www\.', '') = regexp_replace({HOST.format('site')}, '^www\.', '') AS same FROM lk",
        "link_aliases": f"WITH {PAGE}, {LINKS} SELECT * FROM al",
        "link_occurrence": f"WITH {PAGE}, {LINKS} SELECT * FROM oc",
        "frequent_links": f"WITH {PAGE}, {LINKS} SELECT * FROM fq",
        "link_outcomes": f"WITH {ROUTED} SELECT site, page_id, CAST(pos AS INT) AS pos, raw, target, outcome, boilerplate, nofollow FROM rt",
        "broken_links": f"WITH {ROUTED} SELECT site, source, CAST(pos AS INT) AS pos, raw AS target, anchor, why AS reason FROM rt WHERE outcome = 'broken'",
        "redirected_links": f"WITH {ROUTED} SELECT site, source, CAST(pos AS INT) AS pos, raw AS target, anchor, moved AS to FROM rt WHERE outcome = 'edge' AND moved IS NOT NULL",
        "asset_links": f"WITH {ROUTED} SELECT site, raw AS target, count(*) AS links FROM rt WHERE outcome = 'asset' GROUP BY ALL",
        "unverified_links": f"WITH {ROUTED} SELECT site, raw AS target, count(*) AS links FROM rt WHERE outcome = 'unverified' GROUP BY ALL",
        "external_hosts": f"WITH {ROUTED} SELECT site, {HOST.format('raw')} AS host, count(*) AS links FROM rt WHERE outcome = 'external' GROUP BY ALL",
        "edges": f"WITH {ROUTED} SELECT * FROM ed",
        "degrees": f"WITH {DEGREES} SELECT * FROM dg",
        "link_totals": f"""WITH {ROUTED}, t AS (SELECT s.site, (SELECT count(*) FROM pg WHERE pg.site = s.site AND status = 200) AS pages_200, count(e.site) AS total_links, count(*) FILTER (NOT e.boilerplate) AS editorial_links FROM (SELECT DISTINCT site FROM pg) s LEFT JOIN ed e USING (site) GROUP BY s.site)
SELECT *, CAST(editorial_links AS DOUBLE) / greatest(total_links, 1) AS editorial_share, CAST(editorial_links AS DOUBLE) / greatest(pages_200, 1) AS avg_editorial_out, CASE WHEN editorial_share > 0.25 THEN 'comfortable' WHEN editorial_share >= 0.1 THEN 'flag' ELSE 'serious' END AS grade FROM t""",
        "orphans": f"WITH {DEGREES} SELECT site, url FROM dg ANTI JOIN hm USING (site, url) WHERE inbound = 0",
        "no_editorial_in": f"WITH {DEGREES} SELECT site, url, words FROM dg ANTI JOIN hm USING (site, url) WHERE inbound_editorial = 0",
        "dead_ends": f"WITH {DEGREES} SELECT site, url, words FROM dg WHERE outbound_editorial = 0 AND words >= 250",
        "noindex_linked": f"WITH {DEGREES} SELECT site, url, inbound_editorial FROM dg SEMI JOIN (SELECT site, url FROM pg WHERE contains(coalesce(robots_meta, ''), 'noindex') OR contains(coalesce(x_robots_tag, ''), 'noindex')) USING (site, url) WHERE inbound_editorial > 0",
        "site_home": f"WITH {PAGE}, {HOME} SELECT * FROM hm",
        "click_depth": f"{PAGE_DEPTH} SELECT site, url, CAST(depth AS INT) AS depth FROM dp",
        "depth_histogram": f"{PAGE_DEPTH} SELECT site, depth, count(*) AS pages FROM pd GROUP BY ALL",
        "deep_pages": f"{PAGE_DEPTH} SELECT site, url, depth FROM pd WHERE depth >= 4",
        "pagerank": f"{RANK} SELECT site, url, round(rank, 9) AS rank FROM rk",
        "rank_spread": f"{RANK} SELECT site, round(max(rank), 9) AS max_rank, round(min(rank), 9) AS min_rank, min(rank) > 0 AND max(rank) < 1.2 * min(rank) AS undifferentiated FROM rk GROUP BY site",
        "page_grades": f"""{PAGE_DEPTH} SELECT site, url, CASE WHEN depth <= 3 THEN 'comfortable' WHEN depth = 4 THEN 'flag' ELSE 'serious' END AS depth_grade,
CASE WHEN outbound_editorial BETWEEN 3 AND 8 THEN 'comfortable' WHEN outbound_editorial BETWEEN 1 AND 2 THEN 'flag' WHEN outbound_editorial = 0 AND words >= 250 THEN 'serious' END AS out_grade,
CASE WHEN inbound_editorial >= 3 THEN 'comfortable' WHEN inbound_editorial >= 1 THEN 'flag' ELSE 'serious' END AS in_grade FROM dg JOIN pd USING (site, url)""",
        "anchors_by_target": f"WITH {ANCHORS} SELECT site, target, anchor, count(*) AS n FROM ak GROUP BY ALL",
        "weak_anchors": f"WITH {ANCHORS} SELECT site, source, target, CASE WHEN anchor = '' THEN '{EMPTY_ANCHOR}' ELSE anchor END AS anchor FROM ak WHERE anchor = '' OR key IN ({_quote(WEAK_ANCHORS)})",
        "ambiguous_anchors": f"WITH {ANCHORS} SELECT site, key, CAST(count(DISTINCT target) AS INT) AS n, array_to_string(list_sort(list(DISTINCT target)), ' ') AS targets FROM ak WHERE anchor <> '' AND key NOT IN ({_quote(WEAK_ANCHORS)}) AND length(key) > 2 GROUP BY ALL HAVING count(DISTINCT target) > 1",
        "single_anchors": f"WITH {ANCHORS} SELECT site, target, min(anchor) AS anchor, count(*) AS n FROM ak GROUP BY site, target HAVING count(DISTINCT anchor) = 1 AND count(*) >= 3",
        "sections": f"""WITH {ROUTED}, e2 AS (SELECT site, {SECTION.format("source")} AS s, {SECTION.format("target")} AS t FROM ed WHERE NOT boilerplate),
m AS (SELECT site, {SECTION.format("url")} AS section, 'pages' AS kind FROM pg WHERE status = 200 UNION ALL SELECT site, s, 'within' FROM e2 WHERE s = t UNION ALL SELECT site, s, 'out' FROM e2 WHERE s <> t UNION ALL SELECT site, t, 'in' FROM e2 WHERE s <> t)
SELECT site, section, count(*) FILTER (kind = 'pages') AS pages, count(*) FILTER (kind = 'within') AS within, count(*) FILTER (kind = 'out') AS out, count(*) FILTER (kind = 'in') AS "in", count(*) FILTER (kind = 'within') = 0 AS list_only FROM m GROUP BY ALL""",
        "missing_from_sitemap": f"WITH {PAGE}, sm AS (SELECT site, unnest(sitemap) AS url FROM corpus) SELECT site, url FROM pg ANTI JOIN sm USING (site, url) WHERE status = 200 AND NOT coalesce(in_sitemap, false) AND site IN (SELECT site FROM corpus WHERE len(sitemap) > 0)",
        "sitemap_not_crawled": f"WITH {PAGE}, sm AS (SELECT DISTINCT site, unnest(sitemap) AS url FROM corpus) SELECT site, url FROM sm ANTI JOIN pg USING (site, url)",
        "editorial_pairs": f"WITH {PAGE}, {LINKS}, a1 AS (SELECT site, raw, url AS target FROM (SELECT site, url, page_id, 0 AS kind, url AS raw FROM pg UNION ALL SELECT site, url, page_id, 1, final_url FROM pg WHERE final_url <> '') QUALIFY row_number() OVER (PARTITION BY site, raw ORDER BY kind, page_id) = 1) SELECT DISTINCT lk.site, least(source, target) AS a, greatest(source, target) AS b FROM lk JOIN a1 ON a1.site = lk.site AND a1.raw = lk.raw WHERE internal AND NOT tagged",
        "crawl_summary": f"WITH {PAGE} SELECT c.site, count(pg.site) AS fetched, count(*) FILTER (status = 200) AS pages_200, any_value(urls_discovered) AS urls_discovered, CAST(any_value(coalesce(len(sitemap), 0)) AS BIGINT) AS sitemap_urls, any_value(complete) AS complete FROM corpus c LEFT JOIN pg USING (site) GROUP BY c.site",
        "passage_scores": f"WITH {PASSAGES} SELECT page_id, pos, heading, score, words, gaps FROM ps",
        "citability": f"""WITH {PASSAGES}, a AS (SELECT page_id, CAST(sum(score) AS BIGINT) AS points, count(*) AS passages, count(*) FILTER (score >= 5) AS strong FROM ps GROUP BY page_id)
SELECT site, url, round(coalesce(CAST(points AS DOUBLE) / passages, 0), 2) AS mean, coalesce(passages, 0) AS passages, coalesce(strong, 0) AS strong, CASE WHEN passages > 0 THEN CAST(coalesce(n_tables, 0) AS BIGINT) ELSE 0 END AS tables, CASE WHEN passages > 0 THEN CAST(coalesce(n_lists, 0) AS BIGINT) ELSE 0 END AS lists,
CASE WHEN passages > 0 THEN coalesce(len(list_filter(images, lambda i: coalesce(i.alt, '') = '')), 0) ELSE 0 END AS images_without_alt, CASE WHEN passages > 0 THEN CASE WHEN round(CAST(points AS DOUBLE) / passages, 2) >= 4 THEN 'good' WHEN round(CAST(points AS DOUBLE) / passages, 2) >= 3 THEN 'improvable' ELSE 'hard' END END AS grade FROM qe LEFT JOIN a USING (page_id)""",
        "weak_passages": f"WITH {PASSAGES} SELECT site, url, heading, score, words, gaps FROM (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score, pos) = 1) WHERE score <= 2",
        "question_headings": f"WITH {PAGE}, {QUOTABLE}, h AS (SELECT site, list_filter(coalesce(headings, []), lambda h: h.level >= 2 AND coalesce(h.text, '') <> '') AS hs FROM qe) SELECT site, CAST(sum(len(list_filter(hs, lambda x: regexp_matches(x.text, '(?i)^{WS}*({_sql(P.QUESTIONS)})')))) AS BIGINT) AS questions, CAST(sum(len(hs)) AS BIGINT) AS headings FROM h GROUP BY site",
        "js_only": f"WITH {PAGE} SELECT site, url, CAST(coalesce(words, 0) AS BIGINT) AS words, html_bytes AS bytes, html_bytes // 1024 AS kb FROM pg WHERE status = 200 AND coalesce(words, 0) < 120 AND html_bytes > 20000",
        "jsonld_types": f"""WITH {JSONLD}, t AS (SELECT site, unnest(CASE WHEN json_type(o, '$."@type"') = 'ARRAY' THEN json_extract_string(o, '$."@type"[*]') ELSE [json_extract_string(o, '$."@type"')] END) AS type FROM ob) SELECT site, coalesce(type, 'None') AS type, count(*) AS n FROM t GROUP BY ALL""",
        "no_jsonld": f"WITH {JSONLD} SELECT site, url FROM qe WHERE page_id NOT IN (SELECT page_id FROM ob)",
        "same_as": f"""WITH {JSONLD} SELECT DISTINCT site, unnest(json_extract_string(o, '$.sameAs[*]')) AS same_as FROM ob WHERE json_type(o, '$.sameAs') = 'ARRAY'""",
        "no_date": f"WITH {PAGE}, {QUOTABLE} SELECT site, url FROM qe WHERE coalesce(len(dates), 0) = 0 AND NOT regexp_matches(substring(coalesce(text, ''), 1, 2000), '{_DATE}')",
        "no_author": f"WITH {JSONLD} SELECT site, url FROM qe WHERE page_id NOT IN (SELECT page_id FROM ob WHERE json_exists(o, '$.author')) AND NOT regexp_matches(substring(coalesce(text, ''), 1, 1500), '{_BYLINE}')",
        "external_sources": rf"WITH {PAGE}, {QUOTABLE}, x AS (SELECT site, unnest(links) AS l FROM qe) SELECT site, lower(string_split(regexp_replace(coalesce(l.target, ''), '^https?://(www\.)?', ''), '/')[1]) AS host, count(*) AS links FROM x WHERE NOT coalesce(l.internal, false) GROUP BY ALL",
        "entity_links": rf"WITH {PAGE}, {QUOTABLE}, x AS (SELECT site, unnest(links) AS l FROM qe), h AS (SELECT site, lower(string_split(regexp_replace(coalesce(l.target, ''), '^https?://(www\.)?', ''), '/')[1]) AS host FROM x WHERE NOT coalesce(l.internal, false)), e AS (SELECT unnest([{_quote(ENTITY_HOSTS)}]) AS entity) SELECT site, entity, count(*) AS links FROM h JOIN e ON ends_with(host, entity) GROUP BY ALL",
        "html_extract": f"""WITH {PAGE}, t AS (SELECT *, array_to_string(list_transform(coalesce(blocks, []), lambda b: coalesce(b.text, '')), ' ') AS body FROM pg WHERE text IS NOT NULL)
SELECT site, url, {_strip(f"regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g')")} AS title, {_strip("coalesce(description, '')")} AS description, coalesce(lang, '') AS lang, lower({_strip("coalesce(robots_meta, '')")}) AS robots_meta, {_count_words("body")} AS words,
len(list_filter(coalesce(blocks, []), lambda b: {_strip("coalesce(b.heading, '')")} <> '')) AS headings, coalesce(len(jsonld), 0) AS jsonld, coalesce(len(images), 0) AS images, len(list_filter(coalesce(images, []), lambda i: i.has_alt)) AS with_alt, coalesce(len(links), 0) AS links,
len(list_filter(coalesce(links, []), lambda l: regexp_replace({HOST.format("l.target")}, '^www[.]', '') = regexp_replace({HOST.format("site")}, '^www[.]', ''))) AS internal, len(list_filter(coalesce(links, []), lambda l: regexp_matches(l.target, '(?i)[.]({ASSET_ENDINGS})([?]|$)'))) AS assets,
len(list_filter(coalesce(links, []), lambda l: coalesce(l.nofollow, false))) AS nofollow, coalesce(len(links), 0) AS boilerplate FROM t""",
        "sitemap_urls": r"SELECT DISTINCT site, unnest(sitemap) AS url FROM corpus",
        "crawler_access": _access(),
        "llms_files": r"SELECT site, path, coalesce(status BETWEEN 200 AND 399, false) AND (contains(coalesce(content_type, ''), 'text/plain') OR starts_with(ltrim(coalesce(body, ''), chr(10) || chr(13) || chr(9) || ' '), '#')) AS present, CASE WHEN status BETWEEN 200 AND 399 THEN CAST(coalesce(octet_length(encode(body)), 0) AS BIGINT) ELSE 0 END AS bytes FROM site_file WHERE path IN ('/llms.txt', '/llms-full.txt')",
        "declared_sitemaps": rf"SELECT site, unnest(regexp_extract_all(body, '(?im)^\s*sitemap:\s*(\S+)', 1)) AS sitemap FROM site_file WHERE path = '/robots.txt' AND status BETWEEN 200 AND 399 AND body IS NOT NULL AND NOT contains(coalesce(content_type, ''), 'html')",
    }
    return out


def _access() -> str:
    """May the home page be fetched: a group is a run of agent lines and the rules after it; the first group with an agent that the
    crawler's name contains decides, else the group of ``*``; in it, the first rule that the path begins with."""
    rows = ", ".join(f"({i}, '{a}', '{k}', '{_sql(r)}')" for i, (a, k, r) in enumerate([(a, k, r) for k, t in (("answering", ANSWERING), ("training", TRAINING)) for a, r in t]))
    return rf"""WITH a(i, agent, kind, role) AS (VALUES {rows}),
r AS (SELECT site, body FROM site_file WHERE path = '/robots.txt' AND status BETWEEN 200 AND 399 AND body IS NOT NULL AND NOT contains(coalesce(content_type, ''), 'html')),
l AS (SELECT site, n, lower(trim(string_split(x, ':')[1])) AS k, trim(regexp_replace(regexp_replace(x, '^[^:]*:', ''), '#.*$', '')) AS v FROM (SELECT site, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM (SELECT site, string_split(replace(body, chr(13), ''), chr(10)) AS ls FROM r)) WHERE contains(x, ':')),
m AS (SELECT *, lag(k, 1, '') OVER (PARTITION BY site ORDER BY n) AS pk FROM l WHERE k IN ('user-agent', 'allow', 'disallow')),
g AS (SELECT *, sum(CASE WHEN k = 'user-agent' AND pk <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY n) AS grp FROM m),
f AS (SELECT r.site, a.agent, (SELECT min(grp * 2 + CASE WHEN v = '*' THEN 1000000 ELSE 0 END) FROM g WHERE g.site = r.site AND k = 'user-agent' AND (v = '*' OR contains(lower(string_split(a.agent, '/')[1]), lower(v)))) AS pick FROM r, a),
d AS (SELECT f.*, CAST((pick % 1000000) / 2 AS INT) AS grp FROM f),
e AS (SELECT d.site, d.agent, (SELECT arg_min(k = 'allow' OR v = '', n) FROM g WHERE g.site = d.site AND g.grp = d.grp AND k IN ('allow', 'disallow') AND starts_with('/', v)) AS ok FROM d)
SELECT r.site, a.agent, a.kind, a.role, coalesce(e.ok, true) AS allowed, regexp_matches(body, '(?im)^\s*user-agent:\s*' || regexp_escape(a.agent) || '\s*$') AS named FROM r, a JOIN e ON e.site = r.site AND e.agent = a.agent"""
