"""Links of pages: where they lead, which are editorial, and what follows from them.

``pages`` needs ``page_id, site, url, final_url, status, redirects, links`` (and what the functions name), each
page once. The order of a site's pages is that of ``page_id``. ``corpus`` has one row a ``site``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import anchor_key, strip
from corpusmill.functions.urls import hostname, section
from corpusmill.operators.joins import lookup_join

# Anchors that say nothing.
WEAK_ANCHORS = (
    "click here", "here", "read more", "learn more", "more", "see more", "view", "details", "find out more", "continue", "link", "this link", "page", "our site",
    "discover", "go", "next", ">", ">>", "→", "read", "see",
)
#: Share of a site's pages from which a (target, anchor) pair is template.
FREQUENT = 0.60
EMPTY_ANCHOR = "(empty / image with no alt)"


def ok(pages: DataFrame) -> DataFrame:
    return pages.where("status = 200")


def noindex(*fields: str) -> Column:
    """Whether one of the fields speaks against indexing."""
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.coalesce(f, F.lit("")), F.lit("noindex"))
    return out


def aliases(pages: DataFrame, hops: bool = True) -> DataFrame:
    """``site, raw, target``: the page that an address leads to. A page's own address wins, then the first page that ended
    there or (with ``hops``) passed it. Min over a packed rank, so a hot address is combined before the shuffle."""
    names = F.array(F.struct(F.lit(0).alias("kind"), F.col("url").alias("raw")), F.struct(F.lit(1).alias("kind"), F.col("final_url").alias("raw")))
    if hops:
        names = F.concat(names, F.transform(F.coalesce("redirects", F.array().cast("array<string>")), lambda r, i: F.struct((i + 2).cast("int").alias("kind"), r.alias("raw"))))
    rows = pages.select("site", "url", "page_id", F.explode(names).alias("x")).where("x.raw is not null and x.raw <> ''")
    rank = F.struct((F.col("x.kind") > 0).alias("other"), "page_id", "x.kind")
    return rows.groupBy("site", F.col("x.raw").alias("raw")).agg(F.min_by("url", rank).alias("target"))


def exploded(pages: DataFrame, *more: str) -> DataFrame:
    """``site, page_id, source, pos, raw, anchor, boilerplate, internal, asset, nofollow`` of every link; doubled links stay."""
    rows = pages.select("site", "page_id", F.col("url").alias("source"), *more, F.posexplode("links").alias("pos", "l"))
    flags = [F.coalesce(f"l.{c}", F.lit(False)).alias(c) for c in ("boilerplate", "internal", "asset", "nofollow")]
    return rows.select("site", "page_id", "source", *more, "pos", F.col("l.target").alias("raw"), F.coalesce("l.anchor", F.lit("")).alias("anchor"), *flags)


def site_sizes(pages: DataFrame) -> DataFrame:
    """``site, pages_200`` (1 at least)."""
    return pages.groupBy("site").agg(F.greatest(F.count_if(F.col("status") == 200), F.lit(1)).alias("pages_200"))


def occurrences(pages: DataFrame) -> DataFrame:
    """``site, raw, low, pages``: on how many pages, of any status, an internal (target, lower-case anchor) stands."""
    inner = F.filter("links", lambda x: x.internal)
    pairs = F.array_distinct(F.transform(inner, lambda x: F.struct(x.target.alias("raw"), F.lower(F.coalesce(x.anchor, F.lit(""))).alias("low"))))
    return pages.select("site", F.explode(pairs).alias("x")).groupBy("site", "x.raw", "x.low").agg(F.count(F.lit(1)).alias("pages"))


def frequent_pairs(pages: DataFrame, share: float = FREQUENT) -> DataFrame:
    """``site, raw, low`` of the pairs that stand on ``share`` of the site's pages with status 200."""
    counted = lookup_join(occurrences(pages), site_sizes(pages), ["site"])
    return counted.where(F.col("pages") / F.col("pages_200") >= share).select("site", "raw", "low")


def routed(pages: DataFrame, corpus: DataFrame, share: float = FREQUENT) -> DataFrame:
    """Every link of a page with status 200 and its ``outcome``: external, asset, broken, unverified or edge.

    ``target`` is the page it leads to (null where unknown), ``reason`` says why it is broken, ``to`` where the target page
    was redirected to (edges only), ``boilerplate`` joins the tag's flag with the frequency. Files come before the lookup,
    so a missing file is never broken; an unknown target is broken only where the site's crawl is complete (null counts as complete).
    """
    links = exploded(ok(pages))
    attributes = pages.select("site", F.col("url").alias("target"), F.col("status").alias("dest_status"), F.col("final_url").alias("dest_final"), (F.coalesce(F.size("redirects"), F.lit(0)) > 0).alias("dest_moved"))
    known = aliases(pages).join(attributes, ["site", "target"])
    out = lookup_join(links.withColumn("low", F.lower("anchor")), known, ["site", "raw"], "left")
    out = lookup_join(out, frequent_pairs(pages, share).withColumn("frequent", F.lit(True)), ["site", "raw", "low"], "left")
    out = lookup_join(out, corpus.select("site", F.coalesce("complete", F.lit(True)).alias("complete")).dropDuplicates(["site"]), ["site"], "left")
    bad = (F.col("dest_status") == 0) | (F.col("dest_status") >= 400)
    missing = F.col("target").isNull()
    outcome = (
        F.when(~F.col("internal"), "external").when(F.col("asset"), "asset")
        .when(missing & F.coalesce("complete", F.lit(True)), "broken").when(missing, "unverified").when(bad, "broken").otherwise("edge")
    )
    reason = F.when(missing, F.lit("target missing")).otherwise(F.concat(F.lit("HTTP "), F.col("dest_status").cast("string")))
    return out.select(
        "site", "page_id", "source", "pos", "raw", "anchor", "nofollow", "target", outcome.alias("outcome"), (F.col("boilerplate") | F.coalesce("frequent", F.lit(False))).alias("boilerplate"),
        F.when(F.col("outcome") == "broken", reason).alias("reason"), F.when((F.col("outcome") == "edge") & F.col("dest_moved"), F.coalesce("dest_final", F.lit(""))).alias("to"),
    )


def edges(routed: DataFrame) -> DataFrame:
    """``site, source, target, anchor, boilerplate, nofollow`` of the links that lead to a page; doubled ones stay."""
    return routed.where("outcome = 'edge'").select("site", "source", "target", "anchor", "boilerplate", "nofollow")


def home(pages: DataFrame) -> DataFrame:
    """``site, url``: the page at the site's own address, else the one with the shortest address, the first of equal ones."""
    return pages.groupBy("site").agg(F.min_by("url", F.struct(F.col("url") != F.col("site"), F.length("url"), "page_id")).alias("url"))


def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy("site", F.col(key).alias("url")).agg(F.count(F.lit(1)).alias(name))


def degrees(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``site, url, words, inbound, inbound_editorial, outbound_editorial`` of each page with status 200, 0 where it has none.

    Inbound leaves out nofollow, outbound keeps it; a page's links to itself count. One aggregation over both ends.
    """
    ends = edges.select("site", "boilerplate", "nofollow", F.explode(F.array(F.struct(F.col("target").alias("url"), F.lit(True).alias("into")), F.struct(F.col("source").alias("url"), F.lit(False).alias("into")))).alias("e"))
    follow, editorial = ~F.col("nofollow"), ~F.col("boilerplate")
    into = F.col("e.into")
    got = ends.groupBy("site", "e.url").agg(F.count_if(into & follow).alias("inbound"), F.count_if(into & follow & editorial).alias("inbound_editorial"), F.count_if(~into & editorial).alias("outbound_editorial"))
    nodes = ok(pages).select("site", "url", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"))
    names = ["inbound", "inbound_editorial", "outbound_editorial"]
    return nodes.join(got, ["site", "url"], "left").select("site", "url", "words", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def totals(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``site, pages_200, total_links, editorial_links, editorial_share, avg_editorial_out`` of each site."""
    n = pages.groupBy("site").agg(F.count_if(F.col("status") == 200).alias("pages_200"))
    e = edges.groupBy("site").agg(F.count(F.lit(1)).alias("total_links"), F.count_if(~F.col("boilerplate")).alias("editorial_links"))
    rows = n.join(e, "site", "left").select("site", "pages_200", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_links", "editorial_links")))
    share = F.col("editorial_links") / F.greatest("total_links", F.lit(1))
    return rows.withColumn("editorial_share", share).withColumn("avg_editorial_out", F.col("editorial_links") / F.greatest("pages_200", F.lit(1)))


def editorial_anchors(edges: DataFrame) -> DataFrame:
    """``site, source, target, anchor, key`` of the editorial links, anchors stripped."""
    return edges.where(~F.col("boilerplate")).select("site", "source", "target", strip(F.col("anchor")).alias("anchor")).withColumn("key", anchor_key(F.col("anchor")))


def anchors_by_target(edges: DataFrame) -> DataFrame:
    return editorial_anchors(edges).groupBy("site", "target", "anchor").agg(F.count(F.lit(1)).alias("n"))


def weak_anchors(edges: DataFrame) -> DataFrame:
    """Editorial links whose anchor is empty or says nothing."""
    rows = editorial_anchors(edges).where((F.col("anchor") == "") | F.col("key").isin(*WEAK_ANCHORS))
    return rows.select("site", "source", "target", F.when(F.col("anchor") == "", EMPTY_ANCHOR).otherwise(F.col("anchor")).alias("anchor"))


def ambiguous_anchors(edges: DataFrame) -> DataFrame:
    """``site, key, targets``: anchors of more than two characters, not weak, that lead to several pages (sorted). Distinct
    pairs first, so the list of a key is as long as its targets and no longer."""
    rows = editorial_anchors(edges).where((F.col("anchor") != "") & ~F.col("key").isin(*WEAK_ANCHORS) & (F.length("key") > 2))
    return rows.select("site", "key", "target").distinct().groupBy("site", "key").agg(F.array_sort(F.collect_list("target")).alias("targets")).where(F.size("targets") > 1)


def single_anchors(edges: DataFrame, least: int = 3) -> DataFrame:
    """Pages to which ``least`` or more editorial links lead, all with one anchor."""
    one = anchors_by_target(edges).groupBy("site", "target").agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("n"), F.min("anchor").alias("anchor"))
    return one.where((F.col("anchors") == 1) & (F.col("n") >= least)).select("site", "target", "anchor", "n")


def sections(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``site, section, pages, within, out, in, list_only``: editorial links by the first segment of the address.

    ``list_only`` marks a section without links within. One aggregation over both kinds of rows.
    """
    own = ok(pages).select("site", section(F.col("url")).alias("section"), F.lit("pages").alias("kind"))
    e = edges.where(~F.col("boilerplate")).select("site", section(F.col("source")).alias("s"), section(F.col("target")).alias("t"))
    same = F.col("s") == F.col("t")
    moves = F.when(same, F.array(F.struct(F.col("s").alias("section"), F.lit("within").alias("kind")))).otherwise(
        F.array(F.struct(F.col("s").alias("section"), F.lit("out").alias("kind")), F.struct(F.col("t").alias("section"), F.lit("in").alias("kind")))
    )
    rows = own.unionByName(e.select("site", F.explode(moves).alias("m")).select("site", "m.section", "m.kind"))
    out = rows.groupBy("site", "section").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("pages", "within", "out", "in")))
    return out.withColumn("list_only", F.col("within") == 0)


def external_hosts(routed: DataFrame) -> DataFrame:
    return routed.where("outcome = 'external'").groupBy("site", F.coalesce(hostname(F.col("raw")), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("links"))


def not_in_sitemap(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pages with status 200 that their site's sitemap lacks; none for sites without a sitemap."""
    listed = corpus.select("site", F.explode("sitemap").alias("url")).distinct()
    has = corpus.where(F.size("sitemap") > 0).select("site").distinct()
    rows = ok(pages).where(~F.coalesce("in_sitemap", F.lit(False))).select("site", "url")
    return lookup_join(rows, has, ["site"], "left_semi").join(listed, ["site", "url"], "left_anti")


def not_crawled(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """Addresses of a sitemap that were never fetched."""
    return corpus.select("site", F.explode("sitemap").alias("url")).distinct().join(pages.select("site", "url"), ["site", "url"], "left_anti")


def editorial_pairs(pages: DataFrame) -> DataFrame:
    """``site, a, b`` (``a <= b``): pages of which one links to the other outside of template tags, by the tag's flag
    alone, whatever the source's status; nofollow counts, redirect hops do not."""
    rows = exploded(pages).where(F.col("internal") & ~F.col("boilerplate")).select("site", "source", "raw")
    hit = lookup_join(rows, aliases(pages, hops=False), ["site", "raw"])
    return hit.select("site", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def rank_spread(ranks: DataFrame) -> DataFrame:
    """``site, max_rank, min_rank, undifferentiated``: whether the best page's rank is under 1.2 times the least one's."""
    both = ranks.groupBy("site").agg(F.max("rank").alias("max_rank"), F.min("rank").alias("min_rank"))
    return both.withColumn("undifferentiated", (F.col("min_rank") > 0) & (F.col("max_rank") < 1.2 * F.col("min_rank")))


def page_grades(degrees: DataFrame, depths: DataFrame) -> DataFrame:
    """``site, url`` and a grade (comfortable, flag, serious) of the depth, the editorial links out and those in.

    Depth: to 3, 4, beyond or unreachable. Out: 3 to 8, 1 or 2, none on a page of 250 words or more (other cases have none). In: 3 or more, 1 or 2, none.
    """
    d, out, into = F.coalesce("depth", F.lit(99)), F.col("outbound_editorial"), F.col("inbound_editorial")
    return degrees.join(depths, ["site", "url"], "left").select(
        "site", "url", F.when(d <= 3, "comfortable").when(d == 4, "flag").otherwise("serious").alias("depth_grade"),
        F.when(out.between(3, 8), "comfortable").when(out.between(1, 2), "flag").when((out == 0) & (F.col("words") >= 250), "serious").alias("out_grade"),
        F.when(into >= 3, "comfortable").when(into >= 1, "flag").otherwise("serious").alias("in_grade"),
    )


def share_grade(share: Column) -> Column:
    """Grade of a site's editorial share of its links: above a quarter, from a tenth, below."""
    return F.when(share > 0.25, "comfortable").when(share >= 0.10, "flag").otherwise("serious")
