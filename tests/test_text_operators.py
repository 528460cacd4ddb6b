"""Vectors, similar pairs, duplicate groups and page cards on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cards, quotability, similarity, terms

PAGE = (
    "page_id bigint, site string, url string, final_url string, status int, words bigint, robots_meta string, title string, description string, lang string, canonical string, "
    "headings array<struct<level:int,text:string>>, text string, links array<struct<target:string,internal:boolean,boilerplate:boolean>>"
)
WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]


def row(i, text, site="s", title="", links=(), **more):
    base = dict(page_id=i, site=site, url=f"u{i:03}", final_url=None, status=200, words=100, robots_meta=None, title=title, description=None, lang="en", canonical=None, headings=[(1, "head")], text=text, links=list(links))
    return tuple((base | more).values())


@pytest.fixture
def table(spark):
    def doc(a, b):
        return " ".join(WORDS[a:b])

    rows = [
        row(1, doc(0, 60), title="one"), row(2, doc(0, 60), title="one", canonical="c"), row(3, doc(0, 52) + " " + doc(300, 308), links=[("u004", True, False)]), row(4, doc(30, 60) + " " + doc(310, 340)),
        row(5, doc(400, 470)), row(6, None, words=0), row(7, doc(0, 60), robots_meta="noindex"), row(8, doc(0, 60), site="t"), row(9, "", site="v"), row(10, "12 34", site="v"),
    ]
    return spark.createDataFrame(rows, PAGE)


def test_weights(spark):
    t = spark.createDataFrame([row(1, "alpha beta alpha", headings=None), row(2, "alpha gamma", headings=None), row(3, "delta", headings=None)], PAGE)
    docs = terms.documents(t)
    w = {(r.page_id, r.term): r.weight for r in terms.weighted(docs, terms.term_frequency(docs)).collect()}
    assert math.isclose(w[1, "alpha"], 2 / 5 * math.log(1 + 3 / 3)) and math.isclose(w[3, "delta"], math.log(1 + 3 / 2))
    v = terms.vectors(docs)
    assert all(math.isclose(r.n, 1) for r in v.groupBy("page_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    assert [r.term for r in v.where("page_id = 1").orderBy("rk").collect()][:2] == ["alpha", "beta"]


def test_pairs_and_groups(spark, table):
    docs = terms.documents(table)
    v = terms.vectors(docs)
    pairs = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(v).collect()}
    assert math.isclose(pairs[1, 2], 1.0) and (1, 8) not in pairs and (1, 5) not in pairs
    maps = {r.page_id: r.v for r in similarity.packed(v).collect()}
    for (a, b), s in pairs.items():
        assert math.isclose(s, sum(w * maps[b].get(t, 0) for t, w in maps[a].items()))
    groups = similarity.duplicates(similarity.similar_pairs(v), table).collect()
    assert [(g.urls, g.canonicals, g.title) for g in groups] == [(["u001", "u002"], ["c"], "one")]
    assert {r.url for r in similarity.isolated(docs, similarity.similar_pairs(v)).collect()} >= {"u005"}


def test_cap_drops_common_terms_as_candidates_only(spark):
    rows = [(s, i, t, 1, 0.7) for s in ("s",) for i in range(5) for t in ("a", "b")] + [("s", 0, "x", 3, 0.1), ("s", 1, "x", 3, 0.1), ("s", 0, "y", 4, 0.1), ("s", 1, "y", 4, 0.1)]
    v = spark.createDataFrame(rows, "site string, page_id bigint, term string, rk int, weight double")
    assert {(r.a, r.b) for r in similarity.candidate_pairs(v, most_pages=4).collect()} == {(0, 1)}
    assert similarity.candidate_pairs(v).count() == 10


def test_bands(spark):
    got = [r.b for r in spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.5, 0.7, 0.95)], "s double").select(similarity.band(F.col("s")).alias("b")).collect()]
    assert got == ["unrelated", "distant", "complementary", "overlap", "cannibalisation", "same"]


def test_cards_and_empty_tables(spark, table):
    v = terms.vectors(terms.documents(table))
    got = {r.url: r for r in cards.cards(table, v).collect()}
    assert set(got) == {"u001", "u002", "u003", "u004", "u005", "u008", "u009", "u010"}
    assert got["u001"].no_description and got["u001"].issues == [] and len(got["u001"].terms) == 8
    assert [(r.key, r.urls) for r in cards.duplicated(table, F.col("title")).collect()] == [("one", ["u001", "u002"])]
    none = table.limit(0)
    assert terms.vectors(terms.documents(none)).count() == 0
    assert similarity.similar_pairs(v.limit(0)).count() == 0


def test_quotability_nulls(spark):
    ddl = "page_id bigint, site string, url string, status int, words bigint, html_bytes bigint, text string, dates array<string>, jsonld array<string>, n_tables int, n_lists int, images array<struct<alt:string>>, headings array<struct<level:int,text:string>>, blocks array<struct<heading:string,level:int,text:string>>, links array<struct<target:string,internal:boolean>>"
    t = spark.createDataFrame([(1, "s", "u", 200, 50, 30000, None, None, None, None, None, None, None, None, None), (2, "s", "v", 200, 50, None, "by Anna Lee 2024-01-02", [], ["{"], 1, 2, [(None,), ("",), ("x",)], [(2, "Why"), (2, None), (1, "How")], [(None, 0, "w " * 30)], [("https://en.wikipedia.org/x", False), (None, None)])], ddl)
    assert {(r.url, r.mean, r.passages, r.images_without_alt) for r in quotability.citability(t).collect()} == {("u", 0.0, 0, 0), ("v", 2.0, 1, 2)}
    assert [tuple(r) for r in quotability.question_headings(t).collect()] == [("s", 1, 1)]
    a = quotability.attribution(t)
    assert [r.url for r in quotability.without(a, F.col("dated")).collect()] == ["u"] and quotability.without(a, F.size("objects") > 0).count() == 2
    assert [tuple(r) for r in quotability.entity_links(t).collect()] == [("s", "wikipedia.org", 1)]
    assert [r.url for r in quotability.js_only(t).collect()] == ["u"]
