"""How distinctive a term is per record (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Terms in more than 1 / HOT of all record-term pairs are looked up by broadcast: at most HOT terms.
HOT = 2_000


def term_counts(records: DataFrame, key: str, fields: list[str], pattern: str | None = None) -> DataFrame:
    """``key, length, term, tf``: how often each word stands in the record's fields together.

    A word is a longest run of letters and digits, lower-cased. ``length`` counts all words of the
    record, ``pattern`` (a regular expression for the whole word) restricts which terms are returned.
    Null and empty fields have no words.
    """
    words = F.filter(F.split(F.concat_ws(" ", *fields), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = records.select(key, words.alias("__w")).select(key, F.size("__w").alias("length"), F.explode("__w").alias("term"))
    rows = rows.withColumn("term", F.lower("term"))
    if pattern:
        rows = rows.where(F.col("term").rlike(f"^(?:{pattern})$"))
    return rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(records: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("title", "text"), pattern: str | None = None) -> DataFrame:
    """``key, term, tf, df, score`` of every term of every record; ``records`` must hold each record once.

    ``df`` is the number of records with the term and ``score`` is
    ``tf / length * (ln((1 + N) / (1 + df)) + 1)`` with N the number of records. The frequent terms, whose
    number is bounded by HOT, are joined back by broadcast, so that no task gets the rows of a word
    that stands everywhere; each other term has at most a HOT-th of the rows.
    """
    n = records.count()
    tf = term_counts(records, key, list(fields), pattern)
    df = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    pairs = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("s")).first().s
    hot = df.where(F.col("df") > F.lit(max(1_000, pairs // HOT)))
    rest = df.where(F.col("df") <= F.lit(max(1_000, pairs // HOT)))
    common = tf.join(F.broadcast(hot), "term")
    rare = tf.join(F.broadcast(hot.select("term")), "term", "left_anti").join(rest, "term")
    score = F.col("tf") / F.col("length") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    return common.unionByName(rare).select(key, "term", "tf", "df", score.alias("score"))


def distinctive(records: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("title", "text"), pattern: str = "[a-z]{7,}", least_tf: int = 4, df_from: int = 2, df_to: int = 6) -> DataFrame:
    """``key, term`` of the terms used at least ``least_tf`` times in a record and standing in few records."""
    scored = tf_idf(records, key, fields, pattern)
    return scored.where((F.col("tf") >= least_tf) & F.col("df").between(df_from, df_to) & (F.col("score") > 0)).select(key, "term")
