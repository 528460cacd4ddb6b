"""How well pages can be quoted and credited: passages, question headings, dates, authors, structured data, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.passages import grade, has_byline, has_date, is_question, score
from corpusmill.functions.structured import jsonld_objects
from corpusmill.functions.text import word_count
from corpusmill.functions.urls import bare_host

# Hosts that describe entities.
ENTITY_HOSTS = ("wikipedia.org", "wikidata.org", "linkedin.com", "youtube.com", "crunchbase.com", "github.com", "companieshouse.gov.uk")


def eligible(pages: DataFrame, least_words: int = 40) -> DataFrame:
    """Pages with status 200 and ``least_words`` words; those excluded from indexing stay."""
    return pages.where((F.col("status") == 200) & (F.coalesce("words", F.lit(0)) >= least_words))


def js_only(pages: DataFrame, most_words: int = 120, least_bytes: int = 20_000) -> DataFrame:
    """``site, url, words, bytes, kb``: pages that serve much HTML and hardly any text."""
    words, size = F.coalesce("words", F.lit(0)).cast("bigint"), F.coalesce("html_bytes", F.lit(0)).cast("bigint")
    rows = pages.where(F.col("status") == 200).select("site", "url", words.alias("words"), size.alias("bytes"))
    return rows.where((F.col("words") < most_words) & (F.col("bytes") > least_bytes)).withColumn("kb", F.expr("bytes div 1024"))


def passages(pages: DataFrame, least_words: int = 25) -> DataFrame:
    """``site, page_id, url, pos, heading, score, words, gaps`` of each block of ``least_words`` words. Stays within the row."""
    rows = eligible(pages).select("site", "page_id", "url", F.posexplode("blocks").alias("pos", "b")).where(word_count(F.col("b.text")) >= least_words)
    rows = rows.select("site", "page_id", "url", "pos", F.coalesce("b.heading", F.lit("")).alias("heading"), score(F.col("b.heading"), F.col("b.text")).alias("s"))
    return rows.select("site", "page_id", "url", "pos", "heading", "s.score", "s.words", "s.gaps")


def citability(pages: DataFrame) -> DataFrame:
    """``site, url, mean, passages, strong, tables, lists, images_without_alt, grade``; all 0 for a page without a passage."""
    got = passages(pages).groupBy("page_id").agg(F.sum("score").alias("points"), F.count(F.lit(1)).alias("passages"), F.count_if(F.col("score") >= 5).alias("strong"))
    bare = F.coalesce(F.size(F.filter("images", lambda i: F.coalesce(i.alt, F.lit("")) == "")), F.lit(0))
    rows = eligible(pages).select("site", "page_id", "url", "n_tables", "n_lists", F.when(F.col("images").isNull(), 0).otherwise(bare).alias("bare")).join(got, "page_id", "left")
    some = F.col("passages").isNotNull()
    mean = F.round(F.when(some, F.col("points") / F.col("passages")).otherwise(0.0), 2)
    out = rows.select(
        "site", "url", mean.alias("mean"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("passages", "strong")),
        *(F.when(some, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(n) for c, n in (("n_tables", "tables"), ("n_lists", "lists"), ("bare", "images_without_alt"))),
    )
    return out.withColumn("grade", grade(F.col("mean"), F.col("passages")))


def weak_passages(pages: DataFrame, most: int = 2) -> DataFrame:
    """The weakest passage of each page, the first of equal ones, where it scores at most ``most``."""
    worst = passages(pages).groupBy("site", "page_id", "url").agg(F.min_by(F.struct("heading", "score", "words", "gaps"), F.struct("score", "pos")).alias("w"))
    return worst.where(F.col("w.score") <= most).select("site", "url", "w.*")


def question_headings(pages: DataFrame) -> DataFrame:
    """``site, questions, headings``: how many headings below the first level, not empty, ask something."""
    rows = eligible(pages).select("site", F.filter("headings", lambda h: (h.level >= 2) & (F.coalesce(h.text, F.lit("")) != "")).alias("h"))
    asked = F.size(F.filter("h", lambda h: is_question(h.text)))
    size = F.when(F.col("h").isNull(), 0).otherwise(F.size("h"))
    return rows.groupBy("site").agg(F.sum(F.when(F.col("h").isNull(), 0).otherwise(asked)).alias("questions"), F.sum(size).alias("headings"))


def attribution(pages: DataFrame) -> DataFrame:
    """``site, page_id, url, objects, dated, authored`` of each eligible page; one pass, nothing moves."""
    rows = eligible(pages).select("site", "page_id", "url", "text", "dates", jsonld_objects(F.coalesce("jsonld", F.array().cast("array<string>"))).alias("objects"))
    text = F.coalesce("text", F.lit(""))
    dated = (F.coalesce(F.size("dates"), F.lit(0)) > 0) | has_date(text)
    return rows.select("site", "page_id", "url", "objects", dated.alias("dated"), (F.exists("objects", lambda o: o.author) | has_byline(text)).alias("authored"))


def jsonld_types(attribution: DataFrame) -> DataFrame:
    return attribution.select("site", F.explode("objects").alias("o")).select("site", F.explode("o.types").alias("type")).groupBy("site", "type").agg(F.count(F.lit(1)).alias("n"))


def same_as(attribution: DataFrame) -> DataFrame:
    return attribution.select("site", F.explode("objects").alias("o")).select("site", F.explode("o.same_as").alias("same_as")).distinct()


def without(attribution: DataFrame, what: Column) -> DataFrame:
    """Pages for which ``what`` does not hold."""
    return attribution.where(~what).select("site", "url")


def outside_links(pages: DataFrame) -> DataFrame:
    """``site, host`` of every external link of the eligible pages."""
    return eligible(pages).select("site", F.explode(F.filter("links", lambda x: ~F.coalesce(x.internal, F.lit(False)))).alias("l")).select("site", bare_host(F.coalesce("l.target", F.lit(""))).alias("host"))


def external_sources(pages: DataFrame) -> DataFrame:
    return outside_links(pages).groupBy("site", "host").agg(F.count(F.lit(1)).alias("links"))


def entity_links(pages: DataFrame) -> DataFrame:
    """Links by the host of ENTITY_HOSTS that their host ends with; seven literals, so no join."""
    hits = F.filter(F.array(*map(F.lit, ENTITY_HOSTS)), lambda e: F.endswith("host", e))
    return outside_links(pages).select("site", F.explode(hits).alias("entity")).groupBy("site", "entity").agg(F.count(F.lit(1)).alias("links"))
