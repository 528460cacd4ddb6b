"""Breadth-first collection of sites: the frontier is a table, each round fetches a batch of it on the executors.

Network access is behind ``fetch``, a function of an address that gives a response, so that tests and other transports can stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.structured import allowed
from corpusmill.functions.urls import is_asset, normalise
from corpusmill.session import materialize
from corpusmill.sources.html import extract

AGENT = "Mozilla/5.0 (compatible; Corpusmill/1.0)"
RESPONSE = "final_url string, status int, error string, redirects array<string>, content_type string, html_bytes bigint, x_robots_tag string, body binary"


def fetch_http(url: str, timeout: float = 25.0) -> dict:
    """One GET with its redirects. A transport error is status 0, never an exception."""
    import urllib.error
    import urllib.request

    hops: list[str] = []

    class Follow(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, *rest):
            hops.append(req.full_url)
            return super().redirect_request(req, *rest)

    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        try:
            r = urllib.request.build_opener(Follow).open(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            r = e
        body = r.read()
        return {"final_url": r.geturl(), "status": r.status, "redirects": hops, "content_type": r.headers.get("content-type", ""), "html_bytes": len(body), "x_robots_tag": (r.headers.get("x-robots-tag") or "").lower(), "body": body}
    except Exception as e:
        return {"status": 0, "error": str(e)[:200], "redirects": []}


def fetched(front: DataFrame, fetch: Callable[[str], dict], delay: float = 0.0) -> DataFrame:
    """``site, url`` and the response of each row."""
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            got = []
            for url in b.column(1).to_pylist():
                got.append(fetch(url))
                if delay:
                    time.sleep(delay)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g.get(n) for g in got], k) for n, k in zip(names, kinds))], ["site", "url", *names])

    return front.select("site", "url").mapInArrow(run, f"site string, url string, {RESPONSE}")


def crawl(
    spark: SparkSession, sites: list[str], fetch: Callable[[str], dict] = fetch_http, max_pages: int = 150, batch: int = 50, delay: float = 0.2, obey_robots: bool = True,
    robots: DataFrame | None = None, sitemap: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The corpus and page tables of the sites, at most ``max_pages`` pages of each, breadth first.

    ``robots`` (``site, body``) and ``sitemap`` (``site, url``) come from the site's files. Addresses of the sitemap wait until a site's
    frontier is empty, so that they do not push the pages that links reach out of the limit. Files and pages that robots.txt
    forbids are passed over without a record. ``complete`` says that nothing waited at the end.
    """
    base = spark.createDataFrame([(s,) for s in dict.fromkeys(sites)], "site string").select(normalise(F.col("site")).alias("site")).distinct()
    listed = materialize((sitemap.select("site", normalise(F.col("url")).alias("url")).distinct() if sitemap is not None else base.select("site", F.col("site").alias("url")).limit(0)), "sitemap")
    waiting = base.select("site", F.col("site").alias("url"), F.lit(0).alias("round"), F.lit(False).alias("reserve"))
    waiting = materialize(waiting.unionByName(listed.join(waiting.select("site", "url"), ["site", "url"], "left_anti").select("site", "url", F.lit(0).alias("round"), F.lit(True).alias("reserve"))), "waiting")
    pages, step = None, 0
    while True:
        done = pages.select("site", "url") if pages is not None else None
        todo = waiting if done is None else waiting.join(done, ["site", "url"], "left_anti")
        todo = todo.where(~is_asset(F.col("url")))
        if obey_robots and robots is not None:
            rules = todo.join(robots.select("site", "body"), "site", "left")
            todo = rules.where(F.coalesce(F.get(allowed(F.col("body"), F.col("url"), F.array(F.lit(AGENT))), F.lit(0)), F.lit(True))).drop("body")
        count = base.withColumn("n", F.lit(0)).select("site", "n") if done is None else base.join(done.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"))
        order = Window.partitionBy("site").orderBy("reserve", "round", "url")
        active = F.min("reserve").over(Window.partitionBy("site"))
        ready = todo.withColumn("__a", active).where(F.col("reserve") == F.col("__a")).withColumn("__k", F.row_number().over(order)).join(count, "site")
        ready = materialize(ready.where((F.col("__k") <= batch) & (F.col("__k") + F.col("n") <= max_pages)).select("site", "url"), "front")
        if not ready.limit(1).count():
            break
        step += 1
        got = materialize(extract(fetched(ready.repartition("url"), fetch, delay).withColumn("final_url", normalise(F.col("final_url"))).withColumn("redirects", F.transform("redirects", normalise)), listed), "pages")
        pages = got if pages is None else materialize(pages.unionByName(got), "pages")
        found = got.select("site", F.explode("links").alias("l")).where("l.internal and not l.asset").select("site", F.col("l.target").alias("url")).distinct()
        fresh = found.join(waiting.where("not reserve"), ["site", "url"], "left_anti").select("site", "url", F.lit(step).alias("round"), F.lit(False).alias("reserve"))
        rest = waiting.join(fresh.select("site", "url"), ["site", "url"], "left_anti")
        waiting = materialize(rest.unionByName(fresh), "waiting")
    left = todo.groupBy("site").agg(F.count(F.lit(1)).alias("left"))
    known = waiting.groupBy("site").agg(F.count(F.lit(1)).alias("urls_discovered"))
    maps = listed.groupBy("site").agg(F.array_sort(F.collect_list("url")).alias("sitemap"))
    corpus = base.join(known, "site", "left").join(left, "site", "left").join(maps, "site", "left").select(
        "site", F.regexp_extract("site", "^[a-z]+://([^/:]+)", 1).alias("host"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("crawled_at"),
        F.coalesce("sitemap", F.array().cast("array<string>")).alias("sitemap"), "urls_discovered", (F.coalesce("left", F.lit(0)) == 0).alias("complete"), F.lit(max_pages).alias("max_pages"),
    )
    if pages is None:
        pages = extract(fetched(base.select("site", F.col("site").alias("url")).limit(0), fetch))
    return corpus, pages.withColumn("page_id", F.xxhash64("site", "url"))
