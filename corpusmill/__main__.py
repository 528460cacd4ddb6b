"""Command line: ``python -m corpusmill crawl|linking|semantics|geo``."""

from __future__ import annotations

import argparse
import os

from corpusmill import reports
from corpusmill.plans import analyses
from corpusmill.session import ship_package
from corpusmill.sources.corpus import file_name, read_corpus, write_corpus, write_tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="collect a site")
    c.add_argument("url")
    c.add_argument("--max-pages", type=int, default=150)
    c.add_argument("--delay", type=float, default=0.2)
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--ignore-robots", action="store_true")
    c.add_argument("--out", default="")
    for name, limit in (("linking", 12), ("semantics", 15), ("geo", 12)):
        a = sub.add_parser(name, help=f"{name} of a corpus")
        a.add_argument("corpus")
        a.add_argument("--limit", type=int, default=limit)
        a.add_argument("--json", default="", help="folder for the results as JSON lines")
        if name == "semantics":
            a.add_argument("--linking-threshold", type=float, default=0.30)
            a.add_argument("--cannibalisation-threshold", type=float, default=0.70)
            a.add_argument("--thin-words", type=int, default=250)
            a.add_argument("--one-language", action="store_true", help="leave out pairs of two languages")
        if name == "geo":
            a.add_argument("--offline", action="store_true", help="ask no site for its files")
    return p


#: Results that are not written: whole page tables and what the report alone needs.
UNWRITTEN = {"linking": ("external",), "semantics": (), "geo": ()}


def site_files(spark, sites: list[str], paths: tuple[str, ...], fetch=None):
    """``site, path, status, content_type, body`` of the named files of each site."""
    from pyspark.sql import functions as F

    from corpusmill.sources.crawl import fetch_http, fetched

    rows = [(s.rstrip("/") + p, s, p) for s in sites for p in paths]
    got = fetched(spark.createDataFrame([(s, u) for u, s, _ in rows], "site string, url string"), fetch or fetch_http)
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1)
    return got.select("site", path.alias("path"), "status", "content_type", F.decode(F.col("body"), "utf-8").alias("body"))


def main(argv: list[str] | None = None, spark=None, fetch=None) -> str:
    args = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    ship_package(spark)
    if args.command == "crawl":
        from corpusmill.operators.access import robots, sitemap_urls
        from corpusmill.sources.crawl import crawl, fetch_http

        files = site_files(spark, [args.url], ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml"), fetch)
        corpus, pages = crawl(spark, [args.url], fetch or fetch_http, args.max_pages, args.workers, args.delay, not args.ignore_robots, robots(files), sitemap_urls(files))
        site, host = corpus.select("site", "host").first()
        out = args.out or os.path.join("/tmp", file_name(host))
        write_corpus(corpus, pages, out)
        text = f"{reports.crawl_report(corpus, pages, site)}\ncorpus: {out}"
    else:
        corpus, pages = read_corpus(spark, args.corpus)
        site = corpus.select("site").first().site
        if args.command == "linking":
            tables = analyses.linking(corpus, pages)
            text = reports.linking_report(tables, site, args.limit)
        elif args.command == "semantics":
            tables = analyses.semantics(pages, args.linking_threshold, args.cannibalisation_threshold, args.thin_words, args.one_language)
            text = reports.semantics_report(tables, site, args.limit)
        else:
            files = None if args.offline else site_files(spark, [site], ("/robots.txt", "/llms.txt", "/llms-full.txt"), fetch)
            tables = analyses.quotable(pages, files)
            text = reports.quotability_report(tables, site, args.limit)
        if args.json:
            write_tables({k: v for k, v in tables.items() if k not in UNWRITTEN[args.command]}, args.json)
    print(text)
    return text


if __name__ == "__main__":
    main()
