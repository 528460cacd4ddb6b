"""The pN_ queries: each problem's operator with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import distinctive, garbled, language, main_content, mixing, repeated_lines, repetition, residue, set_join, tokenizer
from corpusmill.operators.joins import lookup_join
from corpusmill.sources.tables import pages, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(pages(spark, d, "site", "blocks", "text"))


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.line_statistics(pages(spark, d, "site", "blocks", "text"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d, "site", "blocks", "text")
    return repeated_lines.without_lines(rows, repeated_lines.repeated_lines(rows))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """The same without the nested blocks, of which only the number left is told."""
    return p1_clean(spark, d).select("page_id", "text", F.coalesce(F.size("blocks"), F.lit(0)).alias("blocks_left"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive(pages(spark, d, "title", "text"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.tf_idf(pages(spark, d, "title", "text"))


#: field -> column, kind, least values, least share: of the values that either page has in p3_found, of the larger set in p3_classes
SETS = {"headings": ("headings.text", "values", 6, Fraction(3, 5)), "text": ("text", "words", 100, Fraction(3, 4))}


def _sets(spark: SparkSession, d: str, field: str, of_union: bool = False) -> tuple[DataFrame, DataFrame]:
    column, kind, least, share = SETS[field]
    rows = pages(spark, d, field).select("page_id", F.col(column).alias("v"))
    return set_join.similar_sets(set_join.token_sets(rows, "page_id", "v", kind, least), share, of_union)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field in SETS:
        pairs = set_join.expand(*_sets(spark, d, field, True)).select(F.lit(field).alias("field"), F.col("a").alias("page_a"), F.col("b").alias("page_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a page and field: its class and the number of other classes linked to that class."""
    out = None
    for field in SETS:
        pairs, member = _sets(spark, d, field)
        ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
        links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        rows = lookup_join(member, links, ["class_id"], "left").select(F.lit(field).alias("field"), F.col("id").alias("page_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repaired(pages(spark, d, "text", "title", "description")).select("page_id", "field")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repaired(pages(spark, d, "text", "title", "description"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d, "lang", "words", "blocks")
    return language.mislabelled(rows, language.train(read_table(spark, d, "lang_sample"), pages=rows))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d, "lang", "words", "blocks")
    return language.languages(rows, language.train(read_table(spark, d, "lang_sample"), pages=rows))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.boilerplate_lines(pages(spark, d, "site", "blocks", "links"))


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    """Each page's main body alone."""
    rows = pages(spark, d, "site", "blocks", "text", "links")
    return repeated_lines.without_lines(rows, main_content.boilerplate_lines(rows))


_RESIDUE = ("site", "blocks", "text", "links", "words", "html_bytes")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(pages(spark, d, *_RESIDUE)).select("page_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The pages with a text that are left for later work."""
    rows = pages(spark, d, *_RESIDUE)
    return rows.where(F.col("text").isNotNull()).select("page_id").join(residue.residue_pages(rows).select("page_id"), "page_id", "left_anti")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(read_table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = tokenizer.count_column(read_table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix(sized, read_table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = tokenizer.count_column(read_table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix(sized, read_table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(read_table(spark, d, "documents"))


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return repetition.banded(repetition.measure(read_table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
