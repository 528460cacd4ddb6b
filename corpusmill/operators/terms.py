"""Terms of pages and their weights: unigrams and bigrams, TF-IDF within each site, truncated unit vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import ACCENTED, PLAIN, STOP
from corpusmill.operators.joins import lookup_join
from corpusmill.operators.links import noindex
from corpusmill.session import materialize


SEPARATORS = re.compile("[^a-zà-öø-ÿ0-9]+", re.I)


def eligible(pages: DataFrame, least_words: int = 40) -> DataFrame:
    """Pages with status 200 and ``least_words`` words that their own robots meta does not exclude (the header is not asked)."""
    return pages.where((F.col("status") == 200) & (F.coalesce("words", F.lit(0)) >= least_words) & ~noindex("robots_meta"))


def documents(pages: DataFrame) -> DataFrame:
    """``site, page_id, url, doc``: title, headings and text of the eligible pages as one text."""
    heads = F.array_join(F.transform("headings", lambda h: F.coalesce(h.text, F.lit(""))), " ")
    doc = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(heads, F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return eligible(pages).select("site", "page_id", "url", doc.alias("doc"))


class Tokeniser:
    """The tokens of ``functions.text.tokens``, for Arrow batches; what a run of letters gives is looked up once."""

    def __init__(self):
        self.plain = str.maketrans(ACCENTED, PLAIN)
        self.known: dict[str, bool] = {}

    def keeps(self, run: str) -> bool:
        return len(run) >= 3 and not (run.isascii() and run.isdigit()) and run.translate(self.plain) not in STOP

    def tokens(self, text: str) -> list[str]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        runs = SEPARATORS.split(text.replace("’", " ").lower())
        for r in set(runs).difference(known):
            known[r] = self.keeps(r)
        return [r for r in runs if known[r]]


def term_frequency(docs: DataFrame, text: str = "doc") -> DataFrame:
    """``site, page_id, term, is_bigram, first_pos, f, total`` of every term of every document.

    ``total`` counts all unigrams and bigrams of the document. A document is one row, so its terms are counted where the
    row is, in Arrow batches: nothing is shuffled, and only different terms leave the worker. Null texts give no row; a document
    that comes twice is counted twice.
    """
    names = ["site", "page_id", "term", "is_bigram", "first_pos", "f", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser = Tokeniser()
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                b = batch.slice(start, 100)
                terms, is_bigram, first, f, owner, total = [], [], [], [], [], []
                for i, doc in enumerate(b.column(2).to_pylist()):
                    t = tokeniser.tokens(doc) if doc else []
                    for big, units in ((False, t), (True, [f"{x} {y}" for x, y in zip(t, t[1:])])):
                        counts = Counter(units)  # in the order of their first place
                        places = dict(zip(reversed(units), range(len(units) - 1, -1, -1)))
                        terms += counts
                        f += counts.values()
                        first += [places[x] for x in counts]
                        is_bigram += [big] * len(counts)
                        owner += [i] * len(counts)
                        total += [2 * len(t) - 1] * len(counts)
                at = pa.array(owner, pa.int64())
                columns = [pa.array(terms, pa.string()), pa.array(is_bigram, pa.bool_()), pa.array(first, pa.int32()), pa.array(f, pa.int64()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], names)

    kind = dict(docs.dtypes)["page_id"]
    return docs.select("site", "page_id", text).mapInArrow(run, f"site string, page_id {kind}, term string, is_bigram boolean, first_pos int, f bigint, total bigint")


def document_frequency(tf: DataFrame) -> DataFrame:
    """``site, term, df``."""
    return tf.groupBy("site", "term").agg(F.count(F.lit(1)).alias("df"))


def weighted(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """``tf`` with ``weight``: share of the term in its document times ln(1 + documents / (1 + document frequency)), by site.

    The frequencies are written once, since they are counted and joined again."""
    tf = materialize(tf, "terms")
    sizes = docs.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    df = materialize(lookup_join(document_frequency(tf), sizes, ["site"]), "df")
    return lookup_join(tf, df, ["site", "term"], rows="df").withColumn("weight", F.col("f") / F.col("total") * F.log(1 + F.col("n") / (1 + F.col("df"))))


def vectors(docs: DataFrame, keep: int = 80) -> DataFrame:
    """``site, page_id, term, rk, weight``: the ``keep`` heaviest terms of each document, scaled to length 1.

    Ties (to 12 decimals): unigrams before bigrams, then by first place. The rank and the length share one shuffle by document. A vector of no
    length stays as it is. Sites with fewer than two documents have no vectors.
    """
    tf = term_frequency(docs)
    own = Window.partitionBy("page_id")
    rank = F.row_number().over(own.orderBy(F.desc(F.round("weight", 12)), "is_bigram", "first_pos"))
    top = weighted(docs, tf).where("n >= 2").withColumn("rk", rank).where(F.col("rk") <= keep)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own))
    return top.select("site", "page_id", "term", "rk", (F.col("weight") / F.when(length > 0, length).otherwise(1.0)).alias("weight"))


def lexical_field(vectors: DataFrame, top: int = 25) -> DataFrame:
    """``site, term, weight, rk``: the ``top`` terms of each site by the sum of their weights; ties by term."""
    total = vectors.groupBy("site", "term").agg(F.sum("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc(F.round("weight", 9)), "term"))
    return total.withColumn("rk", rank).where(F.col("rk") <= top)
