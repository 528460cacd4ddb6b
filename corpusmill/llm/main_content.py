"""Page boilerplate mixed with main content (problem 6).

Line-block distribution. What the corpus shows to be template is stripped first, as markup would be: a line that, with
the site's own name masked, is printed on many pages of some sites and on several sites; a notice about scripts that several
sites print beside content; a line of link texts that many sites use. Of
what is left each line has a weight, its text length; lines that stand in no section and are no sentence have
none. The weights are summed over sliding windows of lines of one block: where the sum surges the main text
begins, where it dives it ends, and only lines in between are kept, any number of stretches a page. A page
whose sums never surge has no text to tell from the rest: all that was not stripped is its own text.

No word lists are used but the name of scripts: what a menu says is learned from the texts of links, what is a message from where it stands. Date
lines keep their place, and so do unfinished texts, which are problem 7. Text that was decoded with the wrong encoding is judged by its restored form.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.evidence import unfinished
from corpusmill.llm.garbled import corpus_counts, shared_model
from corpusmill.operators.joins import lookup_join
from corpusmill.session import materialize

#: Lines of a window, and the text length at which a sum of weights surges.
WIDTH, SURGE = 3, 60
#: Sites, and share of all sites, that must use a link text for it to be one of navigation.
LINK_SITES, LINK_SHARE = 2, 0.01
#: Words that a sentence has at least, and from which a line is text however it ends.
SENTENCE, LONG = 6, 20

DATE = re.compile(r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?!\d)")
BRAND = re.compile(r"^(?:https?://)?(?:www\.)?([a-z]{4,})")
DIGITS, WORDS = re.compile("[0-9]+"), re.compile(r"[^\W_]+")
#: What stands between the items of a menu or the steps of a breadcrumb.
BETWEEN = re.compile(r"\s+[|·•»›>/–-]\s+|\s{2,}|\xa0{2,}")
STEPS = re.compile(r"\s[|·•»›>/]\s")
ENDS = frozenset(".!?…»”\")")
MARKS = " \t\xa0>»›•–…!"

LINE = "block_pos int, line_pos int, bare boolean, first boolean, h bigint, length int, tokens int, kind int, rest int"
#: Bits of ``kind``.
DATED, SENTENCES, NAVIGATION, EXTRA, SCRIPTS, THIN = 1, 2, 4, 8, 16, 32
#: What scripts are called, within words.
SCRIPT_STEMS = ("script", "skript", "скрипт")


def masked(line: str, brand: str) -> str:
    """The line as it counts for recurrence: lower case, site name masked, digits as 0, other runs one blank."""
    low = line.lower()
    if brand and brand in low:
        low = low.replace(brand, "qbrandq")
    return " ".join(WORDS.findall(DIGITS.sub("0", low)))


def is_dated(line: str) -> bool:
    """A short line with a calendar date."""
    return len(line) < 75 and DATE.search(line) is not None


def is_steps(line: str) -> bool:
    """Two named steps with a bar between them."""
    sides = line.split(" | ")
    return len(sides) == 2 and all(3 <= s.strip(MARKS).find(":") <= 25 for s in sides)


def is_sentence(line: str, tokens: int) -> bool:
    """Six or more words that end like a sentence, or so many that they are text, and no steps or items with marks between them."""
    ends = tokens >= LONG or tokens >= SENTENCE and (line.rstrip(" \t\xa0>•!")[-1:] in ENDS or line.endswith("!"))
    if not ends or is_steps(line) or len(STEPS.findall(line)) >= 2:
        return False
    items = len(BETWEEN.findall(line)) + 1
    return items < 4 or tokens > 2 * items


def is_navigation(line: str, items: frozenset[str]) -> bool:
    """A line of items of which the first, and half of all, are link texts of many sites; or two named steps."""
    parts = [DIGITS.sub("0", p.strip(MARKS).lower()) for p in BETWEEN.split(line.strip(MARKS))]
    parts = [" ".join(p.split()) for p in parts if p]
    if len(parts) >= 2 and parts[0] in items and (len(parts) >= 3 or parts[1] in items):
        return True
    if len(parts) == 1:
        return parts[0] in items
    return is_steps(line)


def link_texts(pages: DataFrame, source: str) -> frozenset[str]:
    """Texts of internal links that many sites use; at most 1 / LINK_SHARE times as many as a site has on average."""
    inner = F.filter("links", lambda x: x.internal & (F.length(x.anchor) < 40))
    texts = F.array_distinct(F.transform(inner, lambda x: F.trim(F.regexp_replace(F.lower(x.anchor), r"\s+", " "))))
    rows = pages.select(source, F.explode(texts).alias("t")).where("t <> ''").groupBy(source, "t").agg(F.count(F.lit(1)).alias("n"))
    used = rows.groupBy("t").agg(F.count(F.lit(1)).alias("sites"))
    sites = pages.select(source).distinct().count()
    return frozenset(r.t for r in used.where(F.col("sites") >= max(LINK_SITES, LINK_SHARE * sites)).collect())


def page_lines(pages: DataFrame, key: str, source: str, repair: bool, extra: Callable[[str, int], bool] | None = None, floor: float = 1e-3, least: float = 6.5) -> DataFrame:
    """``key, source`` and LINE of all non-blank lines, in restored form; ``extra`` (line, words) sets the bit EXTRA, a column ``thin`` of the page THIN.

    ``bare``: the block has no heading. ``first``: the first line of its kind on the page. ``rest``: letters in the
    page's sentences other than this line.
    """
    spark, name = pages.sparkSession, uuid.uuid4().hex
    counts = None
    if repair:
        got = corpus_counts(pages.select(F.array_join(F.transform("blocks", lambda b: b.text), "\n").alias("t")), ["t"])
        counts = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in got))
    items = spark.sparkContext.broadcast(link_texts(pages, source))
    names = [x.split()[0] for x in LINE.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model(name, counts) if counts else None
        known = items.value
        for b in batches:
            rows, owner = [], []
            for i, (site, blocks, thin) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                brand = m.group(1) if (m := BRAND.match(site)) else ""
                own, seen, total = [], set(), 0
                for bp, block in enumerate(blocks or ()):
                    text, bare = block["text"] or "", not block["heading"]
                    if model is not None and not text.isascii():
                        text = model.repair(text, floor, least)[1]
                    for lp, line in enumerate(text.split("\n")):
                        line = line.strip()
                        if not line:
                            continue
                        tokens = len(line.split())
                        low = masked(line, brand)
                        h = xxhash.xxh64_intdigest(low) - (1 << 63)
                        sentence = is_sentence(line, tokens)
                        kind = DATED * is_dated(line) | SENTENCES * sentence | EXTRA * (extra is not None and extra(line, tokens)) | SCRIPTS * any(x in low for x in SCRIPT_STEMS) | THIN * bool(thin)
                        if not sentence and is_navigation(line, known):
                            kind |= NAVIGATION
                        own.append((bp, lp, bare, h not in seen, h, len(line), tokens, kind))
                        seen.add(h)
                        if sentence:
                            total += len(line)
                for x in own:
                    rows.append((*x, total - x[5] if x[7] & SENTENCES else total))
                owner += [i] * len(own)
            columns = [*zip(*rows)] or [[]] * len(names)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "source", *names])

    rows = pages.select(key, source, F.transform("blocks", lambda x: F.struct(x.heading.alias("heading"), x.text.alias("text"))).alias("blocks"), F.col("thin") if "thin" in pages.columns else F.lit(False).alias("thin"))
    types = dict(pages.dtypes)
    out = rows.mapInArrow(run, f"key {types[key]}, source {types[source]}, {LINE}")
    return out.withColumnRenamed("key", key).withColumnRenamed("source", source)


def recurring_lines(lines: DataFrame, totals: DataFrame, source: str, least_pages: int, share: float) -> DataFrame:
    """``source, h, template, dense, notice, alone, seen`` of the lines that recur.

    ``dense``: on ``least_pages`` pages and ``share`` of the source's pages. ``template``: dense somewhere, on two
    sources or more, and mostly where it is dense. ``notice``: speaks of scripts, on two sources or more.
    ``alone``: on two sources or more, on a third of its pages without other sentences; ``seen`` is on how many pages in all. Counts are combined before the shuffle.
    """
    first = F.col("first")
    scripts = F.max(F.col("kind").bitwiseAND(SCRIPTS) > 0).alias("scripts")
    by_source = lines.groupBy(source, "h").agg(F.count_if(first).alias("pages"), scripts, F.count_if(first & (F.col("rest") < 2 * SURGE)).alias("alone"))
    by_source = lookup_join(by_source, totals, [source])
    by_source = by_source.withColumn("dense", (F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("source_pages")))
    everywhere = by_source.groupBy("h").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if("dense").alias("dense_sources"), F.sum("pages").alias("all_pages"),
        F.sum(F.when(F.col("dense"), F.col("pages")).otherwise(0)).alias("dense_pages"), F.max("scripts").alias("scripts"), F.sum("alone").alias("alone_pages"),
    )
    several = F.col("sources") >= 2
    alone = several & (3 * F.col("alone_pages") >= F.col("all_pages"))
    template = (F.col("sources") >= 2) & (F.col("dense_sources") >= 1) & ((F.col("dense_sources") >= 3) | (F.col("dense_pages") >= 0.3 * F.col("all_pages")))
    notice = several & F.col("scripts")
    kept = everywhere.select("h", template.alias("template"), notice.alias("notice"), alone.alias("alone"), F.col("all_pages").alias("seen"), (F.col("dense_sources") > 0).alias("any")).where("template or notice or alone or any")
    return by_source.select(source, "h", "dense").join(kept, "h").where("template or notice or alone or dense").select(source, "h", "template", "dense", "notice", "alone", "seen")


def decide(block: list[int], bare: list[bool], length: list[int], kind: list[int], dense: list[bool], stripped: list[bool]) -> list[bool]:
    """For each line of a page, in order, whether it is not main content: stripped, or outside of every surge of the window sums. Whether
    the page has text at all is judged without dates and what the site prints on many pages."""
    n = len(block)
    out = list(stripped)
    weight = [0 if out[i] else length[i] if not bare[i] or kind[i] & (SENTENCES | DATED) else 0 for i in range(n)]
    if sum(w for i, w in enumerate(weight) if not (kind[i] & DATED or dense[i])) < SURGE:
        return out
    for i in range(n):
        if not out[i] and not weight[i]:
            total = 0
            for j in range(max(0, i - WIDTH + 2), min(n, i + WIDTH - 1)):
                if block[j] == block[i]:
                    total += weight[j]
            out[i] = total < SURGE
    return out


def marked_lines(pages: DataFrame, key: str, source: str, least_pages: int, share: float, repair: bool) -> DataFrame:
    """``key, lines``: each page's lines in order with what is known of them."""
    base = pages.where(F.size("blocks") > 0).withColumn(source, F.coalesce(source, F.lit("")))
    totals = base.groupBy(source).agg(F.count(F.lit(1)).alias("source_pages"))
    lines = materialize(page_lines(base, key, source, repair, unfinished), "lines")
    known = materialize(recurring_lines(lines, totals, source, least_pages, share), "recurring")
    marked = lookup_join(lines, known, [source, "h"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("template", "dense", "notice", "alone")]
    entry = F.struct("block_pos", "line_pos", "bare", "length", "tokens", "kind", F.coalesce("seen", F.lit(0)).alias("seen"), *flags)
    return marked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("lines"))


def _stripped(p: dict[str, list], a: int, z: int) -> list[bool]:
    """What is stripped before the sums. Template lines and notices that usually stand alone are the page's own text where it has hardly other sentences of its own."""
    kind, template, dense, alone = p["kind"], p["template"], p["dense"], p["alone"]
    own = sum(p["length"][i] for i in range(a, z) if kind[i] & SENTENCES and not (template[i] or dense[i] or alone[i]))
    full = own >= 2 * SURGE
    out = []
    for i in range(a, z):
        nav = kind[i] & NAVIGATION and p["bare"][i]
        out.append(not kind[i] & (DATED | EXTRA) and bool(template[i] and (full or not alone[i]) or nav or p["notice"][i] and full))
    return out


def each_page(by_page: DataFrame, key: str, schema: str, result: Callable) -> DataFrame:
    """Calls ``result(lines, start, end, out)`` for each page; ``lines`` are columns as lists, ``out`` what is no main content. It
    gives the rows of the page."""
    names = [c.split()[0] for c in schema.split(", ")]
    simple = {"int": pa.int32(), "string": pa.string()}
    kinds = [simple[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            ends = column.offsets.to_pylist()
            base = ends[0]
            p = {f.name: c.to_pylist() for f, c in zip(column.type.value_type, column.flatten().flatten())}
            rows, owner = [], []
            for i, (a, z) in enumerate(zip(ends, ends[1:])):
                a, z = a - base, z - base
                out = decide(*(p[c][a:z] for c in ("block_pos", "bare", "length", "kind", "dense")), _stripped(p, a, z))
                got = result(p, a, z, out)
                rows += got
                owner += [i] * len(got)
            columns = [*zip(*rows)] or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", *names])

    return by_page.mapInArrow(run, f"key {dict(by_page.dtypes)[key]}, {schema}").withColumnRenamed("key", key)


def boilerplate_lines(pages: DataFrame, key: str = "page_id", source: str = "site", least_pages: int = 3, share: float = 0.1, repair: bool = True) -> DataFrame:
    """``key, block_pos, line_pos`` of every line that is not main content. ``pages`` (with ``blocks`` and ``links``) must hold each page once.

    Null blocks give no rows; a null source is treated as one without a name; null links have no texts.
    """

    def result(p, a, z, out):
        return [(p["block_pos"][a + i], p["line_pos"][a + i]) for i, o in enumerate(out) if o]

    return each_page(marked_lines(pages, key, source, least_pages, share, repair), key, "block_pos int, line_pos int", result)
