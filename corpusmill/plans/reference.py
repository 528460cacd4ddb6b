"""Queries over the corpus tables, each over its whole tables; lists are joined to text so that SQL can check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.headings import first_h1
from corpusmill.functions.text import tokens
from corpusmill.functions import urls
from corpusmill.operators import access, cards, graph, links, quotability, similarity, terms
from corpusmill.plans.oracle import oracle_sql  # noqa: F401
from corpusmill.session import materialize
from corpusmill.sources.html import extract
from corpusmill.sources.tables import pages, read_table

_GRAPH = ("site", "url", "final_url", "status", "redirects", "links", "words")
_DOCS = ("site", "url", "status", "words", "robots_meta", "title", "headings", "text")
_CARDS = (*_DOCS, "description", "canonical", "lang", "links", "final_url", "redirects")
_QUOTE = ("site", "url", "status", "words", "blocks", "headings", "images", "n_tables", "n_lists", "text", "dates", "jsonld", "links", "html_bytes")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "corpus")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "site_file")


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = pages(spark, d, *_GRAPH)
    return rows, links.routed(rows, _corpus(spark, d))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and edges, the edges written once because their users read them several times."""
    rows, out = _routed(spark, d)
    return rows, materialize(links.edges(out), "edges")


# Terms.


def tokenize_documents(spark, d):
    docs = terms.documents(pages(spark, d, *_DOCS))
    return docs.select("site", "url", F.array_join(tokens(F.col("doc")), " ").alias("tokens"))


def term_frequency(spark, d):
    return terms.term_frequency(terms.documents(pages(spark, d, *_DOCS)))


def document_frequency(spark, d):
    return terms.document_frequency(terms.term_frequency(terms.documents(pages(spark, d, *_DOCS))))


def _vectors(spark, d, *columns):
    rows = pages(spark, d, *(columns or _DOCS))
    docs = terms.documents(rows)
    return rows, docs, materialize(terms.vectors(docs), "vectors")


def tfidf_top80(spark, d):
    return terms.vectors(terms.documents(pages(spark, d, *_DOCS)))


def lexical_field(spark, d):
    return terms.lexical_field(terms.vectors(terms.documents(pages(spark, d, *_DOCS))))


# Similar pages.


def candidate_pairs(spark, d):
    return similarity.candidate_pairs(_vectors(spark, d)[2]).select("site", "a", "b", "shared")


def cosine_pairs(spark, d):
    pairs = similarity.similar_pairs(_vectors(spark, d)[2])
    return pairs.select("site", "a", "b", F.round("similarity", 6).alias("similarity"), similarity.band(F.col("similarity")).alias("band"))


def shared_terms(spark, d):
    pairs = similarity.similar_pairs(_vectors(spark, d)[2])
    return pairs.select("site", "a", "b", F.array_join("terms", ", ").alias("terms"))


def _described(spark, d):
    rows, _, vectors = _vectors(spark, d, *_CARDS)
    return similarity.described(similarity.similar_pairs(vectors), rows, links.editorial_pairs(rows))


_PAIR = ("site", "url_a", "url_b", "title_a", "title_b", "linked")


def _pair_rows(df):
    return df.select(*_PAIR, F.round("similarity", 3).alias("similarity"), F.array_join("terms", ", ").alias("terms"))


def opportunities(spark, d):
    return _pair_rows(similarity.opportunities(_described(spark, d)))


def cannibalisation(spark, d):
    return _pair_rows(similarity.cannibalisation(_described(spark, d)))


def cannibalisation_one_language(spark, d):
    return _pair_rows(similarity.cannibalisation(_described(spark, d), one_language=True))


def duplicates(spark, d):
    rows, _, vectors = _vectors(spark, d, *_CARDS)
    groups = similarity.duplicates(similarity.similar_pairs(vectors), rows)
    return groups.select("site", F.array_join("urls", " ").alias("urls"), F.array_join("canonicals", " ").alias("canonicals"), "title")


def neighbours(spark, d):
    pairs = similarity.similar_pairs(_vectors(spark, d)[2])
    return pairs.select("site", F.explode(F.array("a", "b")).alias("page_id")).groupBy("site", "page_id").agg(F.count(F.lit(1)).alias("neighbours"))


def isolated(spark, d):
    _, docs, vectors = _vectors(spark, d)
    return similarity.isolated(docs, similarity.similar_pairs(vectors))


# Single pages.


def page_cards(spark, d):
    rows, _, vectors = _vectors(spark, d, *_CARDS)
    lists = [F.array_join(c, ", ").alias(c) for c in ("terms", "off_title", "issues")]
    return cards.cards(rows, vectors).select("site", "url", "words", "title", "h1", "no_description", *lists)


def off_title(spark, d):
    rows, _, vectors = _vectors(spark, d, *_CARDS)
    return cards.off_title(cards.cards(rows, vectors)).select("site", "url", "title", F.array_join("off_title", ", ").alias("off_title"))


def thin_content(spark, d):
    rows = terms.eligible(pages(spark, d, *_DOCS)).withColumn("words", F.col("words").cast("bigint"))
    return cards.thin(rows)


def heading_issues(spark, d):
    rows = terms.eligible(pages(spark, d, *_DOCS)).select("site", "url", F.array_join(cards.issues(F.col("headings")), ", ").alias("issues"))
    return rows.where("issues <> ''")


def no_description(spark, d):
    return terms.eligible(pages(spark, d, *_CARDS)).where(F.coalesce("description", F.lit("")) == "").select("site", "url")


def _duplicated(spark, d, value):
    return cards.duplicated(pages(spark, d, *_CARDS), value).select("site", "key", "n", F.array_join("urls", " ").alias("urls"))


def duplicate_titles(spark, d):
    return _duplicated(spark, d, F.col("title"))


def duplicate_h1(spark, d):
    return _duplicated(spark, d, first_h1(F.col("headings")))


def duplicate_descriptions(spark, d):
    return _duplicated(spark, d, F.col("description"))


# Addresses.


def url_normalise(spark, d):
    rows = pages(spark, d, "url", "links").select(F.explode(F.concat(F.array("url"), F.coalesce(F.transform("links", lambda x: x.target), F.array().cast("array<string>")))).alias("url"))
    return rows.distinct().select("url", urls.normalise(F.col("url")).alias("normalised"))


def url_section(spark, d):
    return pages(spark, d, "url").select("url", urls.section(F.col("url")).alias("section"), urls.hostname(F.col("url")).alias("host"))


def url_resolve(spark, d):
    """Each internal link written relative to its site and resolved from its page again."""
    rows = links.exploded(pages(spark, d, *_GRAPH)).where("internal").select("page_id", "source", "raw").distinct()
    return rows.select("page_id", "raw", urls.resolve(F.col("source"), F.regexp_replace("raw", "^https?://[^/]*", "")).alias("resolved"))


def tracking_params(spark, d):
    rows = pages(spark, d, "links").select(F.explode(F.transform("links", lambda x: x.target)).alias("url")).distinct()
    return rows.select("url", F.explode(urls.query_parameters(F.col("url"))).alias("p")).select("url", F.col("p.k").alias("name"), F.col("p.v").alias("value"), urls.is_tracking(F.col("p.k")).alias("tracking"))


def asset_flags(spark, d):
    rows = links.exploded(pages(spark, d, *_GRAPH)).select("raw").distinct()
    return rows.select("raw", urls.is_asset(F.col("raw")).alias("asset"), urls.is_http(F.col("raw")).alias("http"))


def same_site(spark, d):
    rows = links.exploded(pages(spark, d, *_GRAPH)).select("site", "raw").distinct()
    return rows.select("site", "raw", urls.same_site(F.col("raw"), urls.hostname(F.col("site"))).alias("same"))


# Links.


def link_aliases(spark, d):
    return links.aliases(pages(spark, d, *_GRAPH))


def link_occurrence(spark, d):
    return links.occurrences(pages(spark, d, *_GRAPH))


def frequent_links(spark, d):
    return links.frequent_pairs(pages(spark, d, *_GRAPH))


def link_outcomes(spark, d):
    return _routed(spark, d)[1].select("site", "page_id", "pos", "raw", "target", "outcome", "boilerplate", "nofollow")


def broken_links(spark, d):
    return _routed(spark, d)[1].where("outcome = 'broken'").select("site", "source", "pos", F.col("raw").alias("target"), "anchor", "reason")


def redirected_links(spark, d):
    return _routed(spark, d)[1].where("to is not null").select("site", "source", "pos", F.col("raw").alias("target"), "anchor", "to")


def _per_target(spark, d, outcome):
    return _routed(spark, d)[1].where(F.col("outcome") == outcome).groupBy("site", F.col("raw").alias("target")).agg(F.count(F.lit(1)).alias("links"))


def asset_links(spark, d):
    return _per_target(spark, d, "asset")


def unverified_links(spark, d):
    return _per_target(spark, d, "unverified")


def external_hosts(spark, d):
    return links.external_hosts(_routed(spark, d)[1])


def edges(spark, d):
    return links.edges(_routed(spark, d)[1])


def degrees(spark, d):
    return links.degrees(*_edges(spark, d))


def link_totals(spark, d):
    out = links.totals(*_edges(spark, d))
    return out.withColumn("grade", links.share_grade(F.col("editorial_share")))


def _not_home(rows, frame):
    return frame.join(links.home(rows), ["site", "url"], "left_anti")


def orphans(spark, d):
    rows, e = _edges(spark, d)
    return _not_home(rows, links.degrees(rows, e).where("inbound = 0")).select("site", "url")


def no_editorial_in(spark, d):
    rows, e = _edges(spark, d)
    return _not_home(rows, links.degrees(rows, e).where("inbound_editorial = 0")).select("site", "url", "words")


def dead_ends(spark, d):
    return links.degrees(*_edges(spark, d)).where("outbound_editorial = 0 and words >= 250").select("site", "url", "words")


def noindex_linked(spark, d):
    rows, e = _edges(spark, d)
    marked = pages(spark, d, "site", "url", "robots_meta", "x_robots_tag").where(links.noindex("robots_meta", "x_robots_tag")).select("site", "url")
    return links.degrees(rows, e).where("inbound_editorial > 0").join(marked, ["site", "url"], "left_semi").select("site", "url", "inbound_editorial")


def site_home(spark, d):
    return links.home(pages(spark, d, *_GRAPH))


def _depths(spark, d):
    rows, e = _edges(spark, d)
    return rows, e, graph.depths(links.home(rows), e.where("not nofollow"))


def click_depth(spark, d):
    return _depths(spark, d)[2]


def _page_depth(spark, d):
    rows, _, got = _depths(spark, d)
    return links.ok(rows).select("site", "url").join(got, ["site", "url"], "left").withColumn("depth", F.coalesce("depth", F.lit(99)))


def depth_histogram(spark, d):
    return _page_depth(spark, d).groupBy("site", "depth").agg(F.count(F.lit(1)).alias("pages"))


def deep_pages(spark, d):
    return _page_depth(spark, d).where("depth >= 4")


def pagerank(spark, d):
    rows, e = _edges(spark, d)
    return graph.pagerank(links.ok(rows), e.where("not nofollow")).withColumn("rank", F.round("rank", 9))


def rank_spread(spark, d):
    rows, e = _edges(spark, d)
    out = links.rank_spread(graph.pagerank(links.ok(rows), e.where("not nofollow")))
    return out.select("site", *(F.round(c, 9).alias(c) for c in ("max_rank", "min_rank")), "undifferentiated")


def page_grades(spark, d):
    rows, e, got = _depths(spark, d)
    return links.page_grades(links.degrees(rows, e), got)


def anchors_by_target(spark, d):
    return links.anchors_by_target(links.edges(_routed(spark, d)[1]))


def weak_anchors(spark, d):
    return links.weak_anchors(links.edges(_routed(spark, d)[1]))


def ambiguous_anchors(spark, d):
    return links.ambiguous_anchors(links.edges(_routed(spark, d)[1])).select("site", "key", F.size("targets").alias("n"), F.array_join("targets", " ").alias("targets"))


def single_anchors(spark, d):
    return links.single_anchors(links.edges(_routed(spark, d)[1]))


def sections(spark, d):
    return links.sections(*_edges(spark, d))


def missing_from_sitemap(spark, d):
    return links.not_in_sitemap(pages(spark, d, "site", "url", "status", "in_sitemap"), _corpus(spark, d))


def sitemap_not_crawled(spark, d):
    return links.not_crawled(pages(spark, d, "site", "url"), _corpus(spark, d))


def editorial_pairs(spark, d):
    return links.editorial_pairs(pages(spark, d, *_GRAPH))


def crawl_summary(spark, d):
    rows = pages(spark, d, "site", "status").groupBy("site").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("status") == 200).alias("pages_200"))
    c = _corpus(spark, d).select("site", "urls_discovered", F.coalesce(F.size("sitemap"), F.lit(0)).cast("bigint").alias("sitemap_urls"), "complete")
    return c.join(rows, "site", "left").select("site", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("fetched", "pages_200")), "urls_discovered", "sitemap_urls", "complete")


# Quotability.


def passage_scores(spark, d):
    return quotability.passages(pages(spark, d, *_QUOTE)).select("page_id", "pos", "heading", "score", "words", F.array_join("gaps", "; ").alias("gaps"))


def citability(spark, d):
    return quotability.citability(pages(spark, d, *_QUOTE))


def weak_passages(spark, d):
    return quotability.weak_passages(pages(spark, d, *_QUOTE)).select("site", "url", "heading", "score", "words", F.array_join("gaps", "; ").alias("gaps"))


def question_headings(spark, d):
    return quotability.question_headings(pages(spark, d, *_QUOTE))


def js_only(spark, d):
    return quotability.js_only(pages(spark, d, *_QUOTE))


def _attribution(spark, d):
    return quotability.attribution(pages(spark, d, *_QUOTE))


def jsonld_types(spark, d):
    return quotability.jsonld_types(_attribution(spark, d))


def no_jsonld(spark, d):
    return quotability.without(_attribution(spark, d), F.size("objects") > 0)


def same_as(spark, d):
    return quotability.same_as(_attribution(spark, d))


def no_date(spark, d):
    return quotability.without(_attribution(spark, d), F.col("dated"))


def no_author(spark, d):
    return quotability.without(_attribution(spark, d), F.col("authored"))


def external_sources(spark, d):
    return quotability.external_sources(pages(spark, d, *_QUOTE))


def entity_links(spark, d):
    return quotability.entity_links(pages(spark, d, *_QUOTE))


# Access.


def crawler_access(spark, d):
    return access.crawler_rules(_files(spark, d))


def llms_files(spark, d):
    return access.llms_files(_files(spark, d))


def declared_sitemaps(spark, d):
    return access.declared_sitemaps(_files(spark, d))


# HTML.


def _escaped(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def _rendered(rows):
    """Each page written as HTML: its parts in a head, the links in a menu, the blocks under their headings."""

    def text(c):
        return _escaped(F.coalesce(c, F.lit("")))

    def every(column, f):
        return F.coalesce(F.array_join(F.transform(column, f), ""), F.lit(""))

    block = lambda b: F.concat(F.when(text(b.heading) != "", F.concat(F.lit("<h2>"), text(b.heading), F.lit("</h2>"))).otherwise(F.lit("")), F.lit("<p>"), text(b.text), F.lit("</p>"))
    link = lambda x: F.concat(F.lit('<a rel="'), F.when(x.nofollow, F.lit("NoFollow")).otherwise(F.lit("")), F.lit('" href="'), text(x.target), F.lit('">'), text(x.anchor), F.lit("</a>"))
    image = lambda x: F.concat(F.lit('<img src="'), text(x.src), F.when(x.has_alt, F.concat(F.lit('" alt="'), text(x.alt))).otherwise(F.lit("")), F.lit('">'))
    data = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    return F.concat(
        F.lit('<html lang="'), text(F.col("lang")), F.lit('"><head><title>'), text(F.col("title")), F.lit('</title><meta name="description" content="'), text(F.col("description")),
        F.lit('"><meta name="robots" content="'), text(F.upper("robots_meta")), F.lit('"><link rel="canonical" href="'), text(F.col("canonical")), F.lit('">'), every("jsonld", data),
        F.lit("</head><body><nav>"), every("links", link), every("images", image), F.lit("</nav>"), every("blocks", block), F.lit("<script>if (1 < 2) { hide(); }</script></body></html>"),
    )


def html_extract(spark, d):
    """Every page that has a text, written as HTML and read again."""
    names = ("site", "url", "final_url", "status", "text", "title", "description", "lang", "canonical", "robots_meta", "jsonld", "links", "images", "blocks")
    rows = pages(spark, d, *names).where("text is not null")
    page = rows.select("site", "page_id", "url", "final_url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("redirects"),
                       F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(0).cast("bigint").alias("html_bytes"), F.lit("").alias("x_robots_tag"), F.encode(_rendered(rows), "utf-8").alias("body"))
    got = extract(page)

    def number(c):
        return F.coalesce(F.size(c), F.lit(0)).cast("bigint")

    return got.select(
        "site", "url", "title", "description", "lang", "robots_meta", "words", number(F.filter("headings", lambda h: h.text != "")).alias("headings"), number("jsonld").alias("jsonld"), number("images").alias("images"),
        number(F.filter("images", lambda i: i.has_alt)).alias("with_alt"), number("links").alias("links"), number(F.filter("links", lambda x: x.internal)).alias("internal"),
        number(F.filter("links", lambda x: x.asset)).alias("assets"), number(F.filter("links", lambda x: x.nofollow)).alias("nofollow"), number(F.filter("links", lambda x: x.boilerplate)).alias("boilerplate"),
    )


def sitemap_urls(spark, d):
    """The site files hold no sitemap, so each corpus' own is written as one, behind an index, and expanded again."""
    c = _corpus(spark, d).where(F.size("sitemap") > 0)
    root = F.regexp_extract("site", "^(https?://[^/]+)", 1)
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform("sitemap", lambda u: F.concat(F.lit("<url><loc> "), _escaped(u), F.lit("\n</loc></url>"))), ""), F.lit("</urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), root, F.lit("/maps/one.xml</loc></sitemap></sitemapindex>"))
    ok, kind = F.lit(200).alias("status"), F.lit("application/xml").alias("content_type")
    files = c.select("site", F.lit("/maps/one.xml").alias("path"), ok, kind, body.alias("body")).unionByName(c.select("site", F.lit("/sitemap_index.xml").alias("path"), ok, kind, index.alias("body")))
    return access.sitemap_urls(files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
    return own
