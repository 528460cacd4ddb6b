"""Join helpers that stay correct and fast when one side is small or one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; rows here are a few numbers wide, so this is some MB.
BROADCAST_ROWS = 200_000


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, rows: str | None = None) -> DataFrame:
    """Join ``big`` with ``small``, whose keys are unique.

    The size of ``small`` is counted first. Up to ``max_rows`` rows it is broadcast, so that no row
    of ``big`` moves and a key holding a third of ``big`` does no harm. Beyond it the keys that hold more
    than a ``max_rows``-th of ``big`` are split off: they are fewer than ``max_rows``, so their rows of ``small`` are broadcast
    as before, and only the other keys are shuffled. ``how``: inner, left, left_semi or left_anti. Null
    keys match nothing. An empty ``small`` gives what the join type says. ``rows`` names a column of ``small`` that
    holds how many rows of ``big`` have the key, so that they need not be counted (``big`` has no other keys then).
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    limit = max(1000, big.count() // max_rows)
    if rows is not None:
        often = F.broadcast(small.where(F.col(rows) > limit))
        return big.join(often, on, how).unionByName(big.join(often.select(*on), on, "left_anti").join(small.where(F.col(rows) <= limit), on, how))
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*on)
    hot_small = F.broadcast(small.join(F.broadcast(hot), on, "left_semi"))
    often, seldom = big.join(F.broadcast(hot), on, "left_semi"), big.join(F.broadcast(hot), on, "left_anti")
    return often.join(hot_small, on, how).unionByName(seldom.join(small, on, how))
