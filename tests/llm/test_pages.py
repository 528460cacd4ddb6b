"""Main content, residue and language of pages on small sites."""

import pytest

from corpusmill.llm import evidence, main_content, residue

PAGE = "page_id bigint, site string, text string, words bigint, html_bytes bigint, blocks array<struct<heading:string,level:int,text:string>>, links array<struct<target:string,anchor:string,internal:boolean>>"
MENU = "Home | About us | Prices | Help"
COOKIE = "We use cookies to make your visit better. Accept all or choose."
DOWN = "The shop is closed for works. Please come back in the evening."
SCRIPT = "The map needs scripts; here is the plain address instead."


def own(i, s):
    return "\n".join(f"Sentence {chr(97 + i % 26)}{chr(97 + k)} of page {chr(97 + i // 26)}{chr(97 + s)} tells about a thing that no other page of the site tells." for k in range(3))


def page(i, site, blocks, html=9000):
    text = "\n".join(b[2] for b in blocks)
    links = [("x", a, True) for a in ("Home", "About us", "Prices", "Help")]
    return (i, site, text, len(text.split()), html, blocks, links)


def table(spark):
    rows = []
    for s in range(4):
        site = f"https://www.{'abcd'[s] * 5}.example/"
        for i in range(12):
            blocks = [("", 0, MENU), ("Head", 2, own(i, s)), ("", 0, COOKIE)]
            if i == 3:
                blocks.append(("", 0, "Other pages\nA title of a page\nOne more title"))
            if i in (4, 5):
                blocks[1] = ("Head", 2, own(i, s) + "\n" + SCRIPT)
            rows.append(page(100 * s + i, site, blocks))
        rows.append(page(100 * s + 50, site, [("", 0, MENU), ("", 0, DOWN)], 30_000))
        rows.append(page(100 * s + 60, site, [("", 0, f"Garden works from {s + 4} euros {'klmn'[s] * 3}")], 90_000))
    return spark.createDataFrame(rows, PAGE)


def test_main_content(spark):
    got = {tuple(r) for r in main_content.boilerplate_lines(table(spark)).collect()}
    want = set()
    for s in range(4):
        for i in range(12):
            want |= {(100 * s + i, 0, 0), (100 * s + i, 2, 0)}
        want |= {(100 * s + 3, 3, k) for k in range(3)} | {(100 * s + i, 1, 3) for i in (4, 5)} | {(100 * s + 50, 0, 0)}
    assert got == want


def test_messages_are_found_and_short_pages_are_not(spark):
    got = {tuple(r) for r in residue.residue_pages(table(spark)).collect()}
    assert got == {(100 * s + 50, "message") for s in range(4)}


def test_short_real_pages(spark):
    real = ["Wartung und Pflege Ihrer Heizung im Herbst", "The best browser games for rainy days", "Ein Fehler im Getriebe und was man dagegen tut", "Garden maintenance from 40 euros", "Route 404 runs from the harbour to the mill", "A page about JavaScript"]
    rows = [page(i, f"https://www.{'abcdef'[i] * 5}.example/", [("", 0, t)], 50_000) for i, t in enumerate(real)]
    assert residue.residue_pages(spark.createDataFrame(rows, PAGE)).count() == 0


@pytest.mark.parametrize("line, want", [
    ("Welcome to {{ site.name }}, the home of {{product_title}}.", True), ("{0} results for {1}", True), ("Opening hours: undefined – undefined", True), ("Sample text", True),
    ("In this template language the sign {{ name }} stands for a value that is filled in later.", False), ("Lorem ipsum dolor sit amet, consectetur adipiscing", True),
    ("The word null has a long history in many languages.", False), ("", False), ("Texto de ejemplo, sustituir antes de publicar.", True), ("word " * 100_000, False), ("{" * 50_000, False),
])
def test_unfinished(line, want):
    assert evidence.unfinished(line, len(line.split())) is want


def test_long_lines_nulls_and_empty_tables(spark):
    rows = [(1, None, "x", 1, None, [("", 0, "word " * 100_000 + ".")], None), (2, "s", None, None, None, None, None), (3, "s", "", 0, 5, [(None, None, None), ("", 0, " \n ")], [])]
    t = spark.createDataFrame(rows, PAGE)
    assert main_content.boilerplate_lines(t).count() == 0 and residue.residue_pages(t).count() == 0
    assert main_content.boilerplate_lines(t.limit(0)).count() == 0 and residue.residue_pages(t.limit(0)).count() == 0
