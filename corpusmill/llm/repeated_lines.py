"""Lines repeated across one site's documents (problem 1).

For every line of a source: on how many of the source's documents it stands, against how many of
the documents outside. The log-likelihood ratio of the two rates is tested at a false-discovery
rate over all lines; significant excess lines are taken out by an anti-join and the documents put
together again by position.

"Outside" leaves out sources in which the same line is itself dense, since a notice that a hundred
sites share would otherwise be its own evidence of being ordinary; and it holds one added document
with the line at half weight, so that a single source can be tested too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.joins import lookup_join
from corpusmill.session import materialize

#: Step and end of the grid of ratios on which false discoveries are counted.
STEP, TOP = 0.05, 400.0


def normalised(line: Column) -> Column:
    """Lower case, digit runs as 0, other runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}\p{N}]+", " "))


def lines_of(pages: DataFrame, key: str = "page_id", source: str = "site") -> DataFrame:
    """``key, source, block_pos, line_pos, line, n1, n2``: every line that is not empty when normalised.

    ``n1`` and ``n2`` are 128 bits of hash of the normalised line. Null blocks and texts give nothing.
    """
    blocks = pages.select(key, source, F.posexplode("blocks").alias("block_pos", "__b"))
    texts = F.transform(F.split("__b.text", "\n", -1), lambda x: F.struct(x.alias("line"), normalised(x).alias("norm")))
    lines = blocks.select(key, source, "block_pos", F.posexplode(texts).alias("line_pos", "__l")).where("__l.norm <> ''")
    return lines.select(key, source, "block_pos", "line_pos", "__l.line", F.xxhash64("__l.norm").alias("n1"), F.xxhash64(F.lit("2"), "__l.norm").alias("n2"))


def _entropy_part(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln (1 - p), with 0 ln 0 = 0."""
    a = F.when(k > 0, k * F.log(p)).otherwise(0.0)
    return a + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)


def ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio of two rates; 0 unless the first is the greater."""
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    g = 2 * (_entropy_part(k1, n1, p1) + _entropy_part(k2, n2, p2) - _entropy_part(k1, n1, p) - _entropy_part(k2, n2, p))
    return F.when(p1 > p2, F.greatest(g, F.lit(0.0))).otherwise(0.0)


def false_discovery_bound(tested: DataFrame, rate: float) -> float:
    """The least ratio at which at most ``rate`` of the lines kept are expected to be chance.

    Benjamini-Hochberg on a fixed grid: the driver gets one count for each of at most TOP / STEP steps.
    """
    rows = tested.groupBy(F.floor(F.least(F.col("llr"), F.lit(TOP)) / STEP).alias("step")).count().collect()
    total, kept = sum(r["count"] for r in rows), 0
    bound = math.inf
    for r in sorted(rows, key=lambda r: -r.step):
        kept += r["count"]
        p = 0.5 * math.erfc(math.sqrt(r.step * STEP / 2))  # one-sided: only excess counts
        if p * total <= rate * kept:
            bound = r.step * STEP
    return bound


def line_statistics(pages: DataFrame, least_pages: int = 5, share: float = 0.1, rate: float = 0.05, key: str = "page_id", source: str = "site") -> DataFrame:
    """``source, n1, n2, pages, source_pages, outside_pages, llr, significant`` of each line on ``least_pages`` pages of a source.

    ``pages`` must hold each page once. A line counts once a page. Lines on fewer pages are no
    candidates and are not tested. A null source is no source.
    """
    base = pages.where(F.col("text").isNotNull() & F.col(source).isNotNull())
    totals = base.groupBy(source).agg(F.count(F.lit(1)).alias("source_pages"))
    all_pages = totals.agg(F.coalesce(F.sum("source_pages"), F.lit(0)).alias("s")).first().s
    texts = F.transform("blocks", lambda b: F.transform(F.split(F.coalesce(b.text, F.lit("")), "\n", -1), normalised))
    once = base.select(source, F.explode(F.array_distinct(F.flatten(texts))).alias("__n")).where("__n <> ''")
    counts = once.groupBy(source, F.xxhash64("__n").alias("n1"), F.xxhash64(F.lit("2"), "__n").alias("n2")).agg(F.count(F.lit(1)).alias("pages"))
    counts = lookup_join(counts, totals, [source])
    dense = (F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("source_pages"))
    whole = counts.groupBy("n1", "n2").agg(
        F.sum(F.when(~dense, F.col("pages")).otherwise(0)).alias("__loose"),
        F.sum(F.when(dense, F.col("source_pages")).otherwise(0)).alias("__dense_pages"),
        F.max("pages").alias("__most"),
    ).where(F.col("__most") >= least_pages)
    lines = counts.where(F.col("pages") >= least_pages).join(whole, ["n1", "n2"])
    k1, n1 = F.col("pages"), F.col("source_pages")
    own = F.when(dense, 0).otherwise(k1)
    k2 = F.greatest(F.col("__loose") - own, F.lit(0)) + F.lit(0.5)
    n2 = F.lit(all_pages) - F.col("__dense_pages") - F.when(dense, 0).otherwise(n1) + F.lit(1.0)
    # Where little outside is left, nothing says the line is usual there: pseudo pages keep the background far below ``share``.
    n2 = F.greatest(n2, F.when(dense, n1 / F.lit(share)).otherwise(F.lit(0.0)))
    tested = lines.withColumn("outside_pages", k2 - 0.5).withColumn("llr", ratio(k1, n1, k2, F.greatest(n2, k2))).drop("__loose", "__dense_pages", "__most")
    tested = materialize(tested, "lines")
    bound = false_discovery_bound(tested, rate)
    return tested.withColumn("significant", F.col("llr") >= F.lit(bound))


def repeated_lines(pages: DataFrame, least_pages: int = 5, share: float = 0.1, rate: float = 0.05, key: str = "page_id", source: str = "site") -> DataFrame:
    """``key, block_pos, line_pos`` of every line that is a significant repeated line of its source.

    Besides the test, the line stands on at least ``least_pages`` pages and ``share`` of the source's
    pages that have a text.
    """
    stats = line_statistics(pages, least_pages, share, rate, key, source)
    found = stats.where(F.col("significant") & (F.col("pages") >= share * F.col("source_pages"))).select(source, "n1", "n2")
    return lookup_join(lines_of(pages.where(F.col("text").isNotNull()), key, source), found, [source, "n1", "n2"], "left_semi").select(key, "block_pos", "line_pos")


def without_lines(pages: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, text, blocks`` without the found lines, each block's lines in their order.

    Blocks left without a line are dropped with their heading's text; a page of which nothing is left
    has an empty text and no blocks. Pages without a text keep null and their blocks.
    """
    blocks = pages.where(F.col("text").isNotNull()).select(key, F.posexplode("blocks").alias("block_pos", "__b"))
    lines = blocks.select(key, "block_pos", F.col("__b.heading").alias("heading"), F.col("__b.level").alias("level"), F.posexplode(F.split("__b.text", "\n", -1)).alias("line_pos", "line"))
    kept = lines.join(found, [key, "block_pos", "line_pos"], "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x.line), "\n")
    whole = kept.groupBy(key, "block_pos").agg(F.first("heading").alias("heading"), F.first("level").alias("level"), joined.alias("text"))
    entries = F.array_sort(F.collect_list(F.struct("block_pos", F.struct("heading", "level", "text").alias("b"))))
    parts = whole.groupBy(key).agg(F.transform(entries, lambda x: x.b).alias("__blocks"))
    out = pages.select(key, F.col("text").alias("__text"), F.col("blocks").alias("__old")).join(parts, key, "left")
    has = F.col("__text").isNotNull()
    blocks_out = F.when(has, F.coalesce("__blocks", F.slice("__old", 1, 0))).otherwise(F.col("__old"))
    return out.select(key, F.when(has, F.array_join(F.transform(blocks_out, lambda b: b.text), "\n")).alias("text"), blocks_out.alias("blocks"))
