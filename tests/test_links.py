"""Routing of links, degrees, anchors, sections, on a small site whose answers are known."""

import pytest

from corpusmill.operators import links

PAGE = (
    "page_id bigint, site string, url string, final_url string, status int, redirects array<string>, words bigint, in_sitemap boolean, robots_meta string, x_robots_tag string, "
    "links array<struct<target:string,anchor:string,rel:string,boilerplate:boolean,internal:boolean,asset:boolean,nofollow:boolean>>"
)
S = "https://e.example"


def link(target, anchor="text", boilerplate=False, internal=True, asset=False, nofollow=False):
    return (target, anchor, "", boilerplate, internal, asset, nofollow)


def page(i, path, out=(), status=200, final=None, redirects=(), words=300, meta="", header=""):
    return (i, S + "/", S + path, final or S + path, status, list(redirects), words, False, meta, header, list(out or ()))


@pytest.fixture
def site(spark):
    rows = [
        page(1, "/", [link(S + "/a", "Read More."), link(S + "/b", "Shop"), link(S + "/old", "Old"), link(S + "/none"), link(S + "/f.pdf", asset=True), link("https://www.x.example:8080/p", internal=False), link(S + "/err", "Bad")]),
        page(2, "/a", [link(S + "/b", "shop"), link(S + "/a", "me"), link(S + "/n", "", nofollow=True)]),
        page(3, "/b", [link(S + "/a", "SHOP"), link(S + "/b", "shop")], meta="NOINDEX noindex"),
        page(4, "/moved", final=S + "/new", redirects=[S + "/old"]),
        page(5, "/err", status=404), page(6, "/n", words=0), page(7, "/zero", None, status=0), page(8, "/new/x", [link(S + "/n", "Shop")]),
    ]
    return spark.createDataFrame(rows, PAGE)


def corpus(spark, complete):
    return spark.createDataFrame([(S + "/", complete, [S + "/a", S + "/lost"])], "site string, complete boolean, sitemap array<string>")


def test_outcomes(spark, site):
    got = {(r.source, r.raw): (r.outcome, r.reason, r.to) for r in links.routed(site, corpus(spark, True)).collect()}
    assert got[S + "/", S + "/none"] == ("broken", "target missing", None)
    assert got[S + "/", S + "/f.pdf"] == ("asset", None, None)
    assert got[S + "/", S + "/err"] == ("broken", "HTTP 404", None)
    assert got[S + "/", S + "/old"] == ("edge", None, S + "/new")
    assert got[S + "/", "https://www.x.example:8080/p"] == ("external", None, None)
    loose = {(r.source, r.raw): r.outcome for r in links.routed(site, corpus(spark, False)).collect()}
    assert loose[S + "/", S + "/none"] == "unverified" and len(loose) == len(got)


def test_frequency_counts_case_and_reaches_the_bound(spark):
    rows = [page(i, f"/{i}", [link(S + "/1", "Home" if i % 2 else "HOME"), link(S + "/1", "home")] if i <= 3 else []) for i in range(1, 6)]
    five = spark.createDataFrame(rows, PAGE)
    assert {r.boilerplate for r in links.routed(five, corpus(spark, True)).collect()} == {True}
    four = spark.createDataFrame([page(i, f"/{i}", [link(S + "/1", "home")] if i <= 2 else []) for i in range(1, 5)], PAGE)
    assert {r.boilerplate for r in links.routed(four, corpus(spark, True)).collect()} == {False}


def test_degrees_and_anchors(spark, site):
    e = links.edges(links.routed(site, corpus(spark, True)))
    got = {r.url[len(S):]: (r.inbound, r.inbound_editorial, r.outbound_editorial) for r in links.degrees(site, e).collect()}
    assert got["/a"] == (3, 3, 3) and got["/n"] == (1, 1, 0) and got["/moved"] == (1, 1, 0) and got["/new/x"] == (0, 0, 1)
    assert {(r.source, r.anchor) for r in links.weak_anchors(e).collect()} == {(S + "/", "Read More."), (S + "/a", links.EMPTY_ANCHOR)}
    assert {r.key: r.targets for r in links.ambiguous_anchors(e).collect()} == {"shop": [S + "/a", S + "/b", S + "/n"]}
    assert {(r.section, r.pages, r["in"]) for r in links.sections(site, e).where("section = '/b'").collect()} == {("/b", 1, 2)}
    assert links.home(site).first().url == S + "/"
    assert {r.url for r in links.not_crawled(site, corpus(spark, True)).collect()} == {S + "/lost"}
    assert S + "/a" not in {r.url for r in links.not_in_sitemap(site, corpus(spark, True)).collect()}


def test_empty_tables_and_nulls(spark, site):
    none = site.limit(0)
    assert links.routed(none, corpus(spark, True)).count() == 0
    assert links.degrees(none, links.edges(links.routed(none, corpus(spark, True)))).count() == 0
    holes = spark.createDataFrame([(1, S + "/", S + "/", None, 200, None, None, None, None, None, None), (2, S + "/", S + "/x", None, 200, None, None, None, None, None, [(None, None, None, None, None, None, None)])], PAGE)
    assert [r.outcome for r in links.routed(holes, corpus(spark, None)).collect()] == ["external"]
    extra = site.withColumn("low", site.url).withColumn("target", site.url)
    assert links.routed(extra, corpus(spark, True)).count() == links.routed(site, corpus(spark, True)).count()
