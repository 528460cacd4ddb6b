"""Text reports: the first rows of each result of one site, in a fixed order. The rows are cut before they reach the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def _rows(df: DataFrame, site: str, order: list[Column | str], limit: int) -> tuple[int, list]:
    own = df.where(F.col("site") == site)
    return own.count(), own.orderBy(*order).limit(limit).collect()


def _section(out: list[str], title: str, got: tuple[int, list], line: Callable, always: bool = False) -> None:
    n, rows = got
    if n or always:
        out += ["", f"## {title} ({n})", *(f"  - {line(r)}" for r in rows)]


def short(label: str, width: int = 24) -> str:
    """A label cut to ``width``, the cut marked."""
    return label if len(label) <= width else label[: width - 3] + "…"


def crawl_report(corpus: DataFrame, pages: DataFrame, site: str) -> str:
    c = corpus.where(F.col("site") == site).select("urls_discovered", F.coalesce(F.size("sitemap"), F.lit(0)).alias("listed"), "complete", "max_pages").first()
    n = pages.where(F.col("site") == site).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 200).alias("ok")).first()
    text = f"{n.n} pages fetched ({n.ok} with status 200), {c.urls_discovered} addresses discovered, {c.listed} in the sitemap."
    return text if c.complete else f"{text}\nThe crawl stopped at {c.max_pages} pages: depth, PageRank and broken links hold within them only."


def linking_report(t: Tables, site: str, limit: int = 12) -> str:
    total = t["totals"].where(F.col("site") == site).first()
    out = ["# Internal links"]
    if total is not None:
        out.append(f"{total.pages_200} pages with status 200, {total.total_links} internal links, {total.editorial_links} editorial ({total.editorial_share:.0%}, {total.grade}), {total.avg_editorial_out:.1f} a page.")
    _, depths = _rows(t["depth_histogram"], site, ["depth"], 100)
    out.append("Clicks from the home page: " + ", ".join(f"{'4+' if r.depth == 99 else r.depth}: {r.pages}" for r in depths))
    show = lambda name, title, order, line, n=limit: _section(out, title, _rows(t[name], site, order, n), line)
    show("deep", "Four clicks or more, or unreachable", [F.desc("depth"), F.desc("url")], lambda r: f"{'unreachable' if r.depth == 99 else r.depth}: {r.url}")
    show("orphans", "Orphans: no link leads there", ["url"], lambda r: r.url)
    show("no_editorial_in", "No editorial link leads there", ["url"], lambda r: f"{r.url} ({r.words} words)")
    show("noindex_linked", "Kept from the index, yet linked", ["url"], lambda r: f"{r.inbound_editorial}: {r.url}")
    show("dead_ends", "Dead ends", ["url"], lambda r: f"{r.url} ({r.words} words)")
    if (s := t["rank_spread"].where(F.col("site") == site).first()) is not None and s.undifferentiated:
        out += ["", "All pages have nearly the same PageRank: the links promote none."]
    show("pagerank", "PageRank", [F.desc("rank"), "url"], lambda r: f"{r['rank'] * 100:5.2f} %  {r.inbound_editorial:>3} in  {r.url}")
    show("weak_anchors", "Anchors that say nothing", ["source", "target"], lambda r: f"\"{r.anchor}\": {r.source} → {r.target}")
    show("ambiguous_anchors", "One anchor, several pages", ["key"], lambda r: f"\"{r.key}\" → {len(r.targets)}: {', '.join(r.targets[:3])}")
    show("single_anchors", "Always the same anchor", ["target"], lambda r: f"\"{r.anchor}\" ×{r.n} → {r.target}")
    show("sections", "Sections: pages, links within, out, in", [F.desc("pages"), "section"], lambda r: f"{short(r.section):<24} {r.pages:>5} {r.within:>7} {r.out:>5} {r['in']:>5}")
    show("broken", "Broken links", ["source", "target"], lambda r: f"{r.reason}: {r.source} → {r.target}")
    show("assets", "Linked files", [F.desc("links"), "target"], lambda r: f"×{r.links} {r.target}", min(limit, 5))
    show("unverified", "Not verified: outside of the crawl", [F.desc("links"), "target"], lambda r: f"×{r.links} {r.target}")
    show("redirected", "Links to a redirect", ["source", "target"], lambda r: f"{r.source} → {r.target} ⇒ {r.to}")
    show("sitemap_not_crawled", "In the sitemap, not crawled", ["url"], lambda r: r.url)
    show("missing_from_sitemap", "Crawled, not in the sitemap", ["url"], lambda r: r.url)
    show("external", "Outside hosts", [F.desc("links"), "host"], lambda r: f"{r.host} ({r.links})", 8)
    return "\n".join(out)


def semantics_report(t: Tables, site: str, limit: int = 15) -> str:
    status = t["status"].where(F.col("site") == site).first()
    if status is None or status.error:
        return f"# Meaning\n{status.error if status else 'no page of this site'}"
    out = [f"# Meaning: {status.pages} pages", ", ".join(r.term for r in _rows(t["lexical_field"], site, ["rk"], 20)[1])]
    show = lambda name, title, order, line: _section(out, title, _rows(t[name], site, order, limit), line)
    pair = [F.desc("similarity"), F.desc("url_a"), F.desc("url_b")]
    show("opportunities", "Close and not linked", pair, lambda r: f"{r.similarity:.2f}  {r.url_a} ↔ {r.url_b}: {', '.join(r.terms)}")
    show("duplicates", "The same content under several addresses", [F.desc(F.size("urls")), "title"], lambda r: f"{len(r.urls)}, \"{r.title[:60]}\", canonical {', '.join(r.canonicals) or 'none'}: {', '.join(r.urls[:6])}")
    show("cannibalisation", "Too close for two pages", pair, lambda r: f"{r.similarity:.2f} ({'linked' if r.linked else 'not linked'})  {r.url_a} ↔ {r.url_b}: {', '.join(r.terms)}")
    show("isolated", "Pages without a neighbour", ["url"], lambda r: r.url)
    show("thin", "Little text", ["words", "url"], lambda r: f"{r.words:>4} words: {r.url}")
    show("heading_issues", "Headings", ["url"], lambda r: f"{', '.join(r.issues)}: {r.url}")
    show("off_title", "Title beside the content", ["url"], lambda r: f"{r.url}: \"{r.title or '(empty)'}\", text on {', '.join(r.off_title)}")
    for name, title in (("duplicate_titles", "Same title"), ("duplicate_h1", "Same first heading"), ("duplicate_descriptions", "Same description")):
        show(name, title, ["key"], lambda r: f"\"{r.key[:70]}\" ×{r.n}: {', '.join(r.urls[:3])}")
    show("no_description", "No description", ["url"], lambda r: r.url)
    return "\n".join(out)


def quotability_report(t: Tables, site: str, limit: int = 12) -> str:
    out = ["# Quotability"]
    show = lambda name, title, order, line, n=limit: _section(out, title, _rows(t[name], site, order, n), line)
    if "rules" in t:
        if t["rules"].where(F.col("site") == site).limit(1).count():
            closed = t["rules"].where(~F.col("allowed"))
            _section(out, "Answering crawlers kept out", _rows(closed.where("kind = 'answering'"), site, ["agent"], 20), lambda r: f"{r.agent} ({r.role})")
            _section(out, "Training crawlers kept out (a choice)", _rows(closed.where("kind = 'training'"), site, ["agent"], 20), lambda r: r.agent)
        else:
            out.append("No robots.txt: all is allowed.")
        show("llms_files", "llms files", ["path"], lambda r: f"{r.path}: {f'{r.bytes} bytes' if r.present else 'absent'}")
        show("declared_sitemaps", "Sitemaps declared", ["sitemap"], lambda r: r.sitemap)
    show("js_only", "Much HTML, hardly any text", ["url"], lambda r: f"{r.words} words in {r.kb} KB: {r.url}")
    if (q := t["question_headings"].where(F.col("site") == site).first()) is not None:
        out += ["", f"Headings that ask: {q.questions}/{q.headings}" + (f" ({q.questions / q.headings:.0%})" if q.headings else "")]
    hard = t["citability"].where((F.col("site") == site) & (F.col("mean") < 3) & (F.col("passages") > 0)).count()
    out.append(f"Pages hard to quote (mean below 3 of 6): {hard}")
    show("citability", "Pages by mean score", ["mean", "url"], lambda r: f"{r.mean:.1f}/6  {r.passages:>2} passage(s), {r.strong} strong  {r.url}")
    show("weak_passages", "Passages to work on first", ["url"], lambda r: f"{r.url}, \"{r.heading[:60] or '(no heading)'}\" ({r.words} words): {'; '.join(r.gaps[:3])}")
    show("jsonld_types", "JSON-LD types", [F.desc("n"), "type"], lambda r: f"{r.type} ×{r.n}")
    for name, title in (("no_jsonld", "Without JSON-LD"), ("no_date", "Without a date"), ("no_author", "Without an author")):
        _section(out, title, (_rows(t[name], site, ["url"], 1)[0], []), str, always=True)
    show("same_as", "sameAs", ["same_as"], lambda r: r.same_as, 8)
    show("entity_links", "Links to entity hosts", ["entity"], lambda r: f"{r.entity} ×{r.links}")
    show("external_sources", "Sources", [F.desc("links"), "host"], lambda r: f"{r.host} ({r.links})", 8)
    return "\n".join(out)
