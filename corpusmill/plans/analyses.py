"""The three analyses of a corpus as named tables: link structure, meaning, quotability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.headings import first_h1
from corpusmill.operators import access, cards, graph, links, quotability, similarity, terms
from corpusmill.session import materialize


def linking(corpus: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """Every result on links; the edges are routed once and written."""
    routed = materialize(links.routed(pages, corpus), "routed")
    e = links.edges(routed)
    home = links.home(pages)
    deg = materialize(links.degrees(pages, e), "degrees")
    depth = materialize(graph.depths(home, e.where("not nofollow")), "depth")
    rank = materialize(graph.pagerank(links.ok(pages), e.where("not nofollow")), "rank")
    at = deg.select("site", "url").join(depth, ["site", "url"], "left").withColumn("depth", F.coalesce("depth", F.lit(99)))
    inner = deg.join(home, ["site", "url"], "left_anti")
    hidden = pages.where(links.noindex("robots_meta", "x_robots_tag")).select("site", "url")

    def per_target(outcome: str) -> DataFrame:
        return routed.where(F.col("outcome") == outcome).groupBy("site", F.col("raw").alias("target")).agg(F.count(F.lit(1)).alias("links"))

    return {
        "totals": links.totals(pages, e).withColumn("grade", links.share_grade(F.col("editorial_share"))),
        "home": home, "depth": depth, "depth_histogram": at.groupBy("site", "depth").agg(F.count(F.lit(1)).alias("pages")), "deep": at.where("depth >= 4"),
        "degrees": deg, "grades": links.page_grades(deg, depth), "orphans": inner.where("inbound = 0").select("site", "url"),
        "no_editorial_in": inner.where("inbound_editorial = 0").select("site", "url", "words"), "dead_ends": deg.where("outbound_editorial = 0 and words >= 250").select("site", "url", "words"),
        "noindex_linked": deg.where("inbound_editorial > 0").join(hidden, ["site", "url"], "left_semi").select("site", "url", "inbound_editorial"),
        "pagerank": rank.join(deg.select("site", "url", "inbound_editorial"), ["site", "url"]), "rank_spread": links.rank_spread(rank),
        "anchors_by_target": links.anchors_by_target(e), "weak_anchors": links.weak_anchors(e), "ambiguous_anchors": links.ambiguous_anchors(e), "single_anchors": links.single_anchors(e),
        "sections": links.sections(pages, e), "broken": routed.where("outcome = 'broken'").select("site", "source", F.col("raw").alias("target"), "anchor", "reason"),
        "redirected": routed.where("to is not null").select("site", "source", F.col("raw").alias("target"), "to", "anchor"), "assets": per_target("asset"), "unverified": per_target("unverified"),
        "external": links.external_hosts(routed), "missing_from_sitemap": links.not_in_sitemap(pages, corpus), "sitemap_not_crawled": links.not_crawled(pages, corpus),
    }


def semantics(pages: DataFrame, low: float = similarity.LOW, high: float = similarity.HIGH, thin: int = 250, one_language: bool = False) -> dict[str, DataFrame]:
    """Every result on meaning. ``status`` says which sites are too small (fewer than two eligible pages); those have no rows elsewhere."""
    docs = terms.documents(pages)
    v = materialize(terms.vectors(docs), "vectors")
    pairs = materialize(similarity.similar_pairs(v, low), "pairs")
    told = similarity.described(pairs, pages, links.editorial_pairs(pages))
    c = materialize(cards.cards(pages, v), "cards")
    sizes = docs.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    enough = pages.select("site").distinct().join(sizes, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("pages"))
    return {
        "status": enough.withColumn("error", F.when(F.col("pages") < 2, "corpus too small for a semantic analysis")),
        "lexical_field": terms.lexical_field(v), "opportunities": similarity.opportunities(told, high, one_language), "cannibalisation": similarity.cannibalisation(told, high, one_language=one_language),
        "duplicates": similarity.duplicates(pairs, pages), "isolated": similarity.isolated(docs, pairs), "cards": c, "thin": cards.thin(c, thin), "off_title": cards.off_title(c),
        "heading_issues": c.where(F.size("issues") > 0).select("site", "url", "issues"), "no_description": c.where("no_description").select("site", "url"),
        "duplicate_titles": cards.duplicated(pages, F.col("title")), "duplicate_h1": cards.duplicated(pages, first_h1(F.col("headings"))), "duplicate_descriptions": cards.duplicated(pages, F.col("description")),
    }


def quotable(pages: DataFrame, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result on quotability; without ``files`` nothing is said on access."""
    a = quotability.attribution(pages)
    out = {
        "js_only": quotability.js_only(pages), "citability": quotability.citability(pages), "weak_passages": quotability.weak_passages(pages), "question_headings": quotability.question_headings(pages),
        "jsonld_types": quotability.jsonld_types(a), "no_jsonld": quotability.without(a, F.size("objects") > 0), "same_as": quotability.same_as(a), "no_date": quotability.without(a, F.col("dated")),
        "no_author": quotability.without(a, F.col("authored")), "external_sources": quotability.external_sources(pages), "entity_links": quotability.entity_links(pages),
    }
    if files is not None:
        out |= {"rules": access.crawler_rules(files), "llms_files": access.llms_files(files), "declared_sitemaps": access.declared_sitemaps(files)}
    return out
