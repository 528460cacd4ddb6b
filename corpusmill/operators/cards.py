"""Checks of single pages: titles, headings, descriptions, length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.headings import first_h1, issues
from corpusmill.functions.text import strip, tokens
from corpusmill.operators.terms import eligible


def cards(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """``site, page_id, url, words, title, h1, terms, off_title, issues, no_description`` of each eligible page.

    ``terms`` are the eight heaviest; ``off_title`` those of the first four that are single words and stand neither in
    the title nor in the first heading. A page without a vector has no terms.
    """
    top = vectors.where("rk <= 8").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rk", "term"))).alias("t"))
    rows = eligible(pages).select(
        "site", "page_id", "url", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), F.coalesce("title", F.lit("")).alias("title"), first_h1(F.col("headings")).alias("h1"),
        issues(F.col("headings")).alias("issues"), (F.coalesce("description", F.lit("")) == "").alias("no_description"),
    )
    rows = rows.join(top, "page_id", "left").withColumn("terms", F.coalesce(F.transform("t", lambda x: x.term), F.array().cast("array<string>")))
    named = tokens(F.concat_ws(" ", "title", "h1"))
    off = F.filter(F.slice("terms", 1, 4), lambda t: ~F.contains(t, F.lit(" ")) & ~F.array_contains("named", t))
    return rows.withColumn("named", named).withColumn("off_title", off).select("site", "page_id", "url", "words", "title", "h1", "terms", "off_title", "issues", "no_description")


def thin(cards: DataFrame, words: int = 250) -> DataFrame:
    return cards.where(F.col("words") < words).select("site", "url", "words")


def off_title(cards: DataFrame, least: int = 3) -> DataFrame:
    return cards.where(F.size("off_title") >= least)


def duplicated(pages: DataFrame, value: Column) -> DataFrame:
    """``site, key, urls``: eligible pages of one site with the same value (stripped, lower case); empty values are none."""
    rows = eligible(pages).select("site", "url", value.alias("v")).where("v is not null and v <> ''").withColumn("key", F.lower(strip(F.col("v"))))
    many = rows.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("url")).alias("urls"))
    return many.where("n > 1").select("site", "key", "n", "urls")
