"""Readers of the project's tables and the reading rule for pages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.joins import BROADCAST_ROWS
from corpusmill.session import materialize


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the folder ``path``, read as Parquet."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def latest(rows: DataFrame, key: str = "page_id", order: str = "ingested_at", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each ``key``: the one with the greatest ``order``.

    Deliveries of one key are few, so only the keys that occur more than once are looked up (a scan
    of the key column alone). If they are at most ``max_rows`` they are broadcast: all other rows
    stay where they are, and only the rows of repeated keys are shuffled. Otherwise every row is
    shuffled by key. Rows with a null key are dropped, a null ``order`` comes last, rows equal in
    key and order count once (which one stays does not matter when they are copies).
    """
    rows = rows.where(F.col(key).isNotNull())
    dup = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key)
    window = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")

    dup = materialize(dup, "repeated")
    if (n := dup.limit(max_rows + 1).count()) > max_rows:
        return first(rows)
    if n == 0:
        return rows
    few = F.broadcast(dup)
    return rows.join(few, key, "left_anti").unionByName(first(rows.join(few, key, "left_semi")))


def pages(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The page table, each page once, with the given columns (all when none is named)."""
    rows = read_table(spark, path, "page")
    if not columns:
        return latest(rows)
    need = [*dict.fromkeys(["page_id", *columns, "ingested_at"])]
    return latest(rows.select(*need)).select(*dict.fromkeys(["page_id", *columns]))
