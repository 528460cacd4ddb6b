"""Corpus files: one JSON object a site with its pages inside, read into tables and written from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE = (
    "url STRING, final_url STRING, status INT, error STRING, parse_error STRING, redirects ARRAY<STRING>, content_type STRING, html_bytes BIGINT, x_robots_tag STRING, "
    "title STRING, description STRING, lang STRING, canonical STRING, hreflang ARRAY<STRUCT<hreflang:STRING,href:STRING>>, robots_meta STRING, "
    "headings ARRAY<STRUCT<level:INT,text:STRING>>, blocks ARRAY<STRUCT<heading:STRING,level:INT,text:STRING>>, text STRING, words BIGINT, "
    "links ARRAY<STRUCT<target:STRING,anchor:STRING,rel:STRING,boilerplate:BOOLEAN,internal:BOOLEAN,asset:BOOLEAN,nofollow:BOOLEAN>>, jsonld ARRAY<STRING>, "
    "images ARRAY<STRUCT<src:STRING,alt:STRING,has_alt:BOOLEAN,loading:STRING>>, og MAP<STRING,STRING>, dates ARRAY<STRING>, n_tables INT, n_lists INT, n_paragraphs INT, in_sitemap BOOLEAN"
)
CORPUS = f"site STRING, host STRING, crawled_at STRING, sitemap ARRAY<STRING>, urls_discovered BIGINT, complete BOOLEAN, max_pages INT, pages ARRAY<STRUCT<{PAGE}>>"
HEAD = ("site", "host", "crawled_at", "sitemap", "urls_discovered", "complete", "max_pages")


def read_corpus(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The corpus and page tables of corpus files (a path, a list or a glob), by the fixed schema.

    Keys that are missing give null, unknown ones are dropped, a file that is no corpus raises. ``page_id`` is a hash of site and
    address, so it is the same however the files are split; the order of a site's pages in the file is ``page_ord``.
    """
    rows = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pages = rows.select("site", F.posexplode("pages").alias("page_ord", "p")).select("site", "page_ord", "p.*")
    return rows.select(*HEAD), pages.withColumn("page_id", F.xxhash64("site", "url"))


def _fields():
    return StructType.fromDDL(PAGE).fields


def corpus_rows(corpus: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a site with its pages as an array, in the order of ``page_id``. Meant for sites that fit a row; larger ones stay tables."""
    entry = F.struct("page_id", *(f.name for f in _fields()))
    packed = pages.groupBy("site").agg(F.collect_list(entry).alias("x"))
    ordered = F.transform(F.array_sort("x", lambda a, b: F.when(a.page_id < b.page_id, -1).when(a.page_id > b.page_id, 1).otherwise(0)), lambda e: e.dropFields("page_id"))
    return corpus.select(*HEAD).join(packed.select("site", ordered.alias("pages")), "site", "left")


def file_name(host: str) -> str:
    return f"seo-{host.replace('.', '-')}.json"


def write_corpus(corpus: DataFrame, pages: DataFrame, folder: str) -> None:
    """JSON lines in UTF-8, one object a site, in one folder a site (``site=``)."""
    corpus_rows(corpus, pages).withColumn("key", F.col("site")).write.partitionBy("key").mode("overwrite").json(folder)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each named result as JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(os.path.join(folder, name))
