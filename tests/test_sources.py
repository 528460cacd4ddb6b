"""Corpus files, HTML extraction, crawling through a stand-in for the network, the command line, streams."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill.__main__ import main
from corpusmill.operators.access import sitemap_urls
from corpusmill.sources.corpus import read_corpus
from corpusmill.sources.crawl import crawl
from corpusmill.sources.html import extract
from corpusmill.sources.tables import latest
from corpusmill.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # fetch() below is sent to the workers

S = "https://e.example/"
BODY = "<html lang=en><title>{0}</title><nav><a href='/'>Home</a></nav><h1>{0}</h1><p>" + "A word of text stands here. " * 20 + "</p>{1}</html>"
SITE = {
    S: BODY.format("Start", "<a href='a?utm_source=x'>first</a><a href='/b/'>second</a><a href='f.pdf'>file</a><a href='https://other.example/'>out</a>"),
    S + "a": BODY.format("A", "<a href='../b/'>second</a><a href='/hidden'>h</a>"), S + "b/": BODY.format("B", "<a href='gone'>gone</a>"), S + "map-only": BODY.format("M", ""),
    S + "robots.txt": "User-agent: *\nDisallow: /hidden\nSitemap: https://e.example/index.xml\n", S + "index.xml": "<sitemapindex><sitemap><loc>https://e.example/sitemap.xml</loc></sitemap></sitemapindex>",
    S + "sitemap.xml": "<urlset><url><loc>https://e.example/map-only</loc></url></urlset>",
}


def fetch(url):
    if url not in SITE:
        return {"final_url": url, "status": 404, "content_type": "text/html", "redirects": [], "html_bytes": 0, "x_robots_tag": "", "body": b""}
    kind = "text/plain" if url.endswith(".txt") else "application/xml" if url.endswith(".xml") else "text/html"
    body = SITE[url].encode()
    return {"final_url": url, "status": 200, "content_type": kind, "redirects": [], "html_bytes": len(body), "x_robots_tag": "", "body": body}


def robots(spark):
    return spark.createDataFrame([(S, SITE[S + "robots.txt"])], "site string, body string")


def test_crawl(spark):
    listed = spark.createDataFrame([(S, S + "map-only")], "site string, url string")
    corpus, pages = crawl(spark, [S], fetch, delay=0, robots=robots(spark), sitemap=listed)
    got = {r.url: r for r in pages.collect()}
    assert set(got) == {S, S + "a", S + "b/", S + "b/gone", S + "map-only"} and got[S + "b/gone"].status == 404 and got[S + "map-only"].in_sitemap
    assert [(x.target, x.internal, x.asset, x.boilerplate) for x in got[S].links] == [(S, True, False, True), (S + "a", True, False, False), (S + "b/", True, False, False), (S + "f.pdf", True, True, False), ("https://other.example/", False, False, False)]
    assert corpus.first().complete and corpus.first().sitemap == [S + "map-only"]
    corpus, pages = crawl(spark, [S], fetch, max_pages=2, batch=1, delay=0, robots=robots(spark), sitemap=listed)
    assert pages.count() == 2 and not corpus.first().complete and S + "map-only" not in {r.url for r in pages.collect()}


def test_command_line(spark, tmp_path):
    out = str(tmp_path / "corpus")
    assert "4 pages" in main(["crawl", S, "--delay", "0", "--out", out, "--max-pages", "4"], spark, fetch)
    files = f"{out}/*/*.json"
    text = main(["linking", files, "--json", str(tmp_path / "l")], spark)
    assert "PageRank" in text and (tmp_path / "l" / "orphans").exists() and not (tmp_path / "l" / "external").exists()
    assert "Meaning" in main(["semantics", files, "--thin-words", "500"], spark)
    assert "llms files" in main(["geo", files], spark, fetch)
    assert "llms files" not in main(["geo", files, "--offline"], spark, fetch)


def test_sitemap_expansion(spark):
    rows = [(S, "/robots.txt", 200, "text/plain", SITE[S + "robots.txt"]), (S, "/index.xml", 200, "application/xml", SITE[S + "index.xml"]), (S, "/sitemap.xml", 200, "application/xml", SITE[S + "sitemap.xml"]), (S, "/sitemap_index.xml", 404, None, None)]
    files = spark.createDataFrame(rows, "site string, path string, status int, content_type string, body string")
    assert [r.url for r in sitemap_urls(files).collect()] == [S + "map-only"]
    assert sitemap_urls(files.limit(0)).count() == 0


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"site": S, "complete": True, "unknown": 1, "sitemap": [], "pages": [{"url": S, "status": 0, "error": "e", "links": [], "blocks": []}, {"url": S + "a", "status": 200, "text": "é"}]}, ensure_ascii=False, indent=1))
    corpus, pages = read_corpus(spark, str(path))
    assert corpus.first().host is None and [(r.page_ord, r.url, r.status, r.text) for r in pages.orderBy("page_ord").collect()] == [(0, S, 0, None), (1, S + "a", 200, "é")]
    path.write_text("{broken")
    with pytest.raises(Exception):
        read_corpus(spark, str(path))[0].collect()


def test_extract_of_what_is_no_page(spark):
    ddl = "site string, url string, final_url string, status int, error string, redirects array<string>, content_type string, html_bytes bigint, x_robots_tag string, body binary, extra int"
    rows = [(S, S + "x", None, 0, "e", [], None, None, None, None, 1), (S, S + "y", S + "y", 500, None, [], "text/html", 1, "", b"<p>a", 1), (S, S + "z", S + "z", 200, None, [], "image/png", 1, "", b"\x89", 1), (S, S + "e", S + "e", 200, None, [], "TEXT/HTML", 0, "", b"", 1)]
    got = {r.url: r for r in extract(spark.createDataFrame(rows, ddl)).collect()}
    assert all(got[S + k].text is None and got[S + k].links == [] and got[S + k].blocks == [] for k in "xyz") and got[S + "e"].text == "" and got[S + "e"].words == 0


def test_latest(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, None), (None, 3), (3, 5), (3, 5)], "page_id bigint, ingested_at int")
    for bound in (10, 0):
        assert sorted((r.page_id, r.ingested_at or 0) for r in latest(rows, max_rows=bound).collect()) == [(1, 2), (2, 0), (3, 5)]


def test_stream(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 7).alias("page_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).alias("ingested_at"), F.lit(200).alias("status"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), str(tmp_path / "in"))
    ingest.write_once(ingest.once(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    q = ingest.counts_by_window(stream, "status", "ingested_at").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 20
