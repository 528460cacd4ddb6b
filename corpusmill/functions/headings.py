"""Column functions on an array of headings (``level``, ``text``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip


def first_h1(headings: Column) -> Column:
    """Text of the first heading of level 1, be it empty; empty where there is none."""
    return F.coalesce(F.get(F.filter(headings, lambda h: h.level == 1), F.lit(0)).text, F.lit(""))


def issues(headings: Column) -> Column:
    """What is wrong with the order of the headings, as an array: no or several of level 1, the first level
    skipped, headings without text. Null counts as no heading."""
    n1 = F.coalesce(F.size(F.filter(headings, lambda h: h.level == 1)), F.lit(0))
    n1 = F.when(headings.isNull(), 0).otherwise(n1)
    levels = F.transform(headings, lambda h: h.level)
    after = F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))).alias("p"), after.alias("n"))
    skip = F.get(F.filter(pairs, lambda x: (x.p > 0) & (x.n > x.p + 1)), F.lit(0))
    empty = F.size(F.filter(headings, lambda h: strip(F.coalesce(h.text, F.lit(""))) == ""))
    return F.array_compact(F.array(
        F.when(n1 == 0, F.lit("no H1")).when(n1 > 1, F.concat(n1.cast("string"), F.lit(" H1s"))),
        F.when(skip.isNotNull(), F.concat(F.lit("skips H"), skip.p.cast("string"), F.lit("→H"), skip.n.cast("string"))),
        F.when(empty > 0, F.concat(empty.cast("string"), F.lit(" empty heading(s)"))),
    ))
