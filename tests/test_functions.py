"""Column functions against hand-derived cases (FIXTURES.md) and the standard library."""

import random
from urllib.parse import parse_qsl, urlencode, urljoin

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import headings, passages, structured, text, urls
from corpusmill.sources.html import parse


def one(spark, column, *values, types="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.r for r in spark.createDataFrame(rows, f"i int, v {types}").select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, text.tokens, "The garden of Eden 2024", "œuvre d'été", "read more about bread and butter", "cats and dogs", "", None, "x’y ÉTÉ Über 12a")
    assert got == [["garden", "eden"], ["uvre"], ["bread", "butter"], ["cats", "dogs"], [], None, ["über", "12a"]]


def test_bigrams(spark):
    got = one(spark, lambda c: text.bigrams(text.tokens(c)), "cats and dogs eat", "cats", "", None)
    assert got == [["cats dogs", "dogs eat"], [], [], None]


def test_normalise(spark):
    cases = {
        "HTTP://Ex.com:80//a///b?b=2&a=1#f": "http://ex.com/a/b?a=1&b=2", "https://ex.com": "https://ex.com/", "https://ex.com:8443/a/": "https://ex.com:8443/a/",
        "https://ex.com/a?utm_source=x&refresh=1&q=": "https://ex.com/a?q=", "https://u:p@Ex.com/a;v=1": "https://ex.com/a", "https://ex.com/?q=a+b%20c~*é%zz": "https://ex.com/?q=a+b+c~%2A%C3%A9%25zz",
    }
    assert one(spark, urls.normalise, *cases, None) == [*cases.values(), None]
    rng = random.Random(1)
    queries = ["&".join(f"{rng.choice('abxyz')}{rng.choice(['', '=', '=1', '=%41', '=ü', '=a=b', '=+'])}" for _ in range(4)) for _ in range(50)]
    want = ["https://e.example/" + (f"?{x}" if (x := urlencode(sorted(parse_qsl(q, keep_blank_values=True)))) else "") for q in queries]
    assert one(spark, urls.normalise, *(f"https://e.example/?{q}" for q in queries)) == want


def test_resolve(spark):
    base = "https://e.example/a/b/c?x=1"
    refs = ["", "/x", "y", "../y", "../../../y", "./", "..", "?q=2", "#f", "//h.example/z", "https://h.example/", "a//b", "x/../y", "mailto:a", "/a/./b/../c", "y?q#f", "a/b/"]
    assert one(spark, lambda c: urls.resolve(F.lit(base), c), *refs) == [urljoin(base, r) for r in refs]
    assert one(spark, lambda c: urls.resolve(F.lit("https://e.example"), c), "y", "/z") == ["https://e.example/y", "https://e.example/z"]


def test_sections_and_hosts(spark):
    got = one(spark, urls.section, "https://e.example/", "https://e.example", "https://e.example//a/b", "https://e.example/a;x=1?q", None)
    assert got == ["/(root)", "/(root)", "/a", "/a", None]
    assert one(spark, urls.hostname, "https://u@WWW.e.example:80/a", "/a", None) == ["www.e.example", "", None]
    assert one(spark, lambda c: urls.same_site(c, F.lit("e.example")), "https://www.e.example/", "https://x.example/") == [True, False]
    assert one(spark, urls.is_asset, "https://e.example/a.PDF?x", "https://e.example/a.pdf.html", "https://e.example/x.jpg") == [True, False, True]


def test_heading_issues(spark):
    def h(*levels, text="t"):
        return [(x, text) for x in levels]

    got = one(spark, headings.issues, [], h(1, 2, 3), h(1, 3, 6), h(3, 1, 1), h(2, text=" "), None, types="array<struct<level:int,text:string>>")
    assert got == [["no H1"], [], ["skips H1→H3"], ["2 H1s"], ["no H1", "1 empty heading(s)"], ["no H1"]]
    assert one(spark, headings.first_h1, [(1, ""), (1, "b")], [(2, "a")], None, types="array<struct<level:int,text:string>>") == ["", "", ""]


def test_passages(spark):
    body = "It has 12 km of paths and 30 trees. " + "word " * 70
    cases = [("What is X", "X is a park. It has 12 km and 30 trees. " + "word " * 70), ("", "X is a park. It has 12 km and 30 trees. " + "word " * 70), ("Overview", "Therefore " + "word " * 48 + "end."), ("", "neutral " + "word " * 399), (None, None), ("Islands", body)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h string, t string").select("i", passages.score(F.col("h"), F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s.score for r in rows] == [6, 5, 1, 1, 1, 5]
    assert passages.NO_HEADING in rows[1].s.gaps and rows[4].s.words == 0
    assert one(spark, passages.is_question, "Islands of Brittany", "Candles", "Où aller", "OÙ aller", "Garden") == [True, True, True, True, False]
    assert one(spark, passages.figures, "2024-01-02", "1,234,567", "50% of 12 km", "10h30") == [3, 2, 2, 0]
    assert one(spark, passages.has_date, "on 3 March 2024", "le 3 février 2024", "2024-01-02", "in 2024", "x" * 2000 + " 2024-01-02") == [True, True, True, False, False]
    assert one(spark, passages.has_byline, "By Anna Lee", "served by the kitchen", "nothing here") == [True, True, False]


def test_long_and_empty_texts(spark):
    long = "word " * 200_000
    assert one(spark, text.word_count, long, "", None, " a b") == [200_000, 0, 0, 2]
    assert one(spark, text.sentences, "A. B! C?D", "", None) == [["A.", "B!", "C?D"], [], None]
    assert len(one(spark, text.tokens, long)[0]) == 200_000
    assert one(spark, lambda c: passages.score(F.lit("h"), c), long)[0].words == 200_000


def test_jsonld(spark):
    cases = ['{"@type":"Article","author":{"@type":"Person"}}', '{"@graph":[{"@type":["Organization","Brand"],"sameAs":["https://a"]}]}', '{"@type":"WebSite","sameAs":"https://a"}', "not json", "[[{\"@type\":null}]]"]
    got = one(spark, structured.jsonld_objects, *([c] for c in cases), None, types="array<string>")
    assert [[(o.types, o.same_as, o.author) for o in g] for g in got] == [[(["Article"], [], True)], [(["Organization", "Brand"], ["https://a"], False)], [(["WebSite"], [], False)], [], [(["None"], [], False)], []]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /admin/\n\nUser-agent: GPTBot\nDisallow: /\nSitemap: https://e.example/s.xml\n"
    agents = F.array(F.lit("GPTBot"), F.lit("Bingbot"))
    assert one(spark, lambda c: structured.allowed(c, F.lit("https://e.example/"), agents), body, None) == [[False, True], None]
    assert one(spark, lambda c: structured.named(c, F.lit("gptbot")), body, "user-agent: gptbot-x") == [True, False]
    assert one(spark, structured.sitemap_lines, body) == [["https://e.example/s.xml"]]
    assert one(spark, structured.locations, "<urlset><url><LOC> https://a\n/b </LOC></url></urlset>") == [["https://a/b"]]


@pytest.mark.parametrize("kind, body, want", [("text/html; charset=iso-8859-1", "é".encode("latin-1"), "é"), ("text/html", b'<meta charset="cp1251">' + "я".encode("cp1251"), '<meta charset="cp1251">я'), (None, "humidité".encode(), "humidité"), ("text/html; charset=none-such", b"a", "a")])
def test_charset(kind, body, want):
    assert structured.decode(body, kind) == want


def test_html():
    p = parse('<html lang="fr"><head><svg><title>S</title></svg><title> A\n b </title><meta name=description content=" d "><meta name=robots content=NoIndex><meta name=googlebot content=nofollow><link rel="Canonical" href="/c">'
              '<meta property="article:published_time" content="2024"></head><body><nav><a href="/x" rel=NoFollow>X</a></nav>intro<h1>T</h1>one<h2>Q</h3><p>A <b>b</b></p><time datetime=2023></time>'
              '<a href="/p"><img alt="Pic" data-src=i.png></a><noscript><a href="/q">t</a></noscript><a href="mailto:x">m</a><script>var t="</p>";</script><a href="/lost">never<table><ul><ol></ol></ul></table>')  # fmt: skip
    assert (p["title"], p["lang"], p["description"], p["robots_meta"], p["canonical"], p["dates"]) == ("S", "fr", "d", "noindex nofollow", "/c", ["2024", "2023"])
    assert [(x["href"], x["anchor"], x["boilerplate"], x["rel"]) for x in p["links"]] == [("/x", "X", True, "nofollow"), ("/p", "Pic", False, ""), ("/q", "", False, "")]
    assert p["headings"] == [{"level": 1, "text": "T"}, {"level": 2, "text": "Q"}]
    assert [(b["heading"], b["level"], b["text"]) for b in p["blocks"]] == [("", 0, "A b intro"), ("T", 1, "one"), ("Q", 2, "A b m never")]
    assert (p["n_tables"], p["n_lists"], p["n_paragraphs"], p["images"][0]["src"], p["images"][0]["has_alt"]) == (1, 2, 1, "i.png", True)
