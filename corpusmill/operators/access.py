"""What a site's files allow: robots rules for known crawlers, llms files, declared sitemaps; sitemap expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.structured import allowed, is_sitemap_index, locations, named, sitemap_lines
from corpusmill.functions.urls import normalise, resolve
from corpusmill.session import materialize

# Crawlers that answer, and crawlers that collect for training, with who runs them.
ANSWERING = (
    ("OAI-SearchBot", "OpenAI — ChatGPT search index"), ("ChatGPT-User", "OpenAI — user-triggered browsing"), ("PerplexityBot", "Perplexity — index"),
    ("Perplexity-User", "Perplexity — on-demand browsing"), ("Claude-SearchBot", "Anthropic — search index"), ("Claude-User", "Anthropic — on-demand browsing"),
    ("Googlebot", "Google — AI Overviews and AI Mode use the classic index"), ("Bingbot", "Bing / Copilot"), ("Amazonbot", "Amazon — Rufus, Alexa"), ("meta-externalagent", "Meta AI"),
)
TRAINING = (
    ("GPTBot", "OpenAI — training"), ("ClaudeBot", "Anthropic — training"), ("Google-Extended", "Google — Gemini training"),
    ("Applebot-Extended", "Apple Intelligence — training"), ("CCBot", "Common Crawl"), ("Bytespider", "ByteDance"),
)


def served(files: DataFrame) -> DataFrame:
    """Files delivered without an error (status 200 to 399)."""
    return files.where(F.col("status").between(200, 399) & F.col("body").isNotNull())


def robots(files: DataFrame) -> DataFrame:
    """``site, body`` of each robots.txt that was served as anything but HTML."""
    return served(files).where((F.col("path") == "/robots.txt") & ~F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))).select("site", "body")


def crawler_rules(files: DataFrame) -> DataFrame:
    """``site, agent, kind, role, allowed, named``: may each crawler fetch the home page, and is it named. Sites without a
    robots.txt have no row (all is allowed). Each file is parsed once; the crawlers are sixteen literals."""
    agents = [(a, k, r) for k, rows in (("answering", ANSWERING), ("training", TRAINING)) for a, r in rows]
    names = F.array(*(F.lit(a) for a, _, _ in agents))
    table = F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(k).alias("kind"), F.lit(r).alias("role")) for a, k, r in agents))
    rows = robots(files).withColumn("may", allowed(F.col("body"), F.col("site"), names))
    rows = rows.select("site", "body", F.explode(F.arrays_zip(table.alias("a"), F.col("may").alias("may"))).alias("x"))
    return rows.select("site", "x.a.agent", "x.a.kind", "x.a.role", F.col("x.may").alias("allowed"), named(F.col("body"), F.col("x.a.agent")).alias("named"))


def llms_files(files: DataFrame) -> DataFrame:
    """``site, path, present, bytes`` of ``/llms.txt`` and ``/llms-full.txt``: present when served as plain text or beginning with ``#``."""
    good = F.col("status").between(200, 399)
    text = F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/plain")) | F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)^\s+", "").startswith("#")
    rows = files.where(F.col("path").isin("/llms.txt", "/llms-full.txt"))
    return rows.select("site", "path", (F.coalesce(good, F.lit(False)) & text).alias("present"), F.when(good, F.coalesce(F.octet_length("body"), F.lit(0))).otherwise(0).cast("bigint").alias("bytes"))


def declared_sitemaps(files: DataFrame) -> DataFrame:
    """``site, sitemap``: addresses that the robots.txt names."""
    return robots(files).select("site", F.explode(sitemap_lines(F.col("body"))).alias("sitemap"))


def sitemap_urls(files: DataFrame, most_rounds: int = 6, most_files: int = 26) -> DataFrame:
    """``site, url`` (normalised, distinct) of all sitemaps, those that an index names included.

    Start: what robots.txt names, ``/sitemap.xml`` and ``/sitemap_index.xml``; indexes are followed level by level, at most ``most_files`` files a
    site (the reference's bound, first by level, then by address). Files that were not delivered give nothing.
    """
    bodies = served(files).select("site", resolve(F.col("site"), F.col("path")).alias("file"), "body")
    starts = F.array(resolve(F.col("site"), F.lit("/sitemap.xml")), resolve(F.col("site"), F.lit("/sitemap_index.xml")))
    front = files.select("site").distinct().select("site", F.explode(starts).alias("file")).unionByName(declared_sitemaps(files).withColumnRenamed("sitemap", "file")).distinct()
    seen, found = None, None
    for level in range(most_rounds):
        now = front.withColumn("level", F.lit(level))
        seen = now if seen is None else seen.unionByName(now)
        seen = materialize(seen, "sitemaps")
        read = bodies.join(front, ["site", "file"]).select("site", "file", locations(F.col("body")).alias("locs"), is_sitemap_index(F.col("body")).alias("index"))
        read = materialize(read, "locations").withColumn("level", F.lit(level))
        found = read if found is None else found.unionByName(read)
        front = read.where("index").select("site", F.explode("locs").alias("file")).distinct().join(seen, ["site", "file"], "left_anti")
        front = materialize(front, "front")
        if not front.limit(1).count():
            break
    order = F.array_sort(F.collect_list(F.struct("level", "file")))
    taken = seen.groupBy("site").agg(F.slice(order, 1, most_files).alias("s")).select("site", F.explode("s.file").alias("file"))
    urls = found.where(~F.col("index")).join(taken, ["site", "file"], "left_semi").select("site", F.explode("locs").alias("url"))
    return urls.select("site", normalise(F.col("url")).alias("url")).distinct()
