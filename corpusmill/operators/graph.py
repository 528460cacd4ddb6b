"""Iterative algorithms on directed graphs, many graphs (sites) at once.

A site whose edges are few is worked off whole in one task, all such sites in one shuffle. The bound is
checked before; sites beyond it are worked off round by round over the whole cluster, with the state
written to the shared folder every few rounds so that a lost executor costs little. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.joins import lookup_join
from corpusmill.session import materialize

#: Rows (nodes and edges) of a site that one task may hold: some hundred MB.
TASK_ROWS = 2_000_000
#: Rounds between two written states.
EVERY = 5


def _split(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Sites within the limit, and those beyond it (None if there are none)."""
    sizes = nodes.select("site").unionByName(edges.select("site")).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > limit).select("site"), "large")
    return large, (large if large.limit(1).count() else None)


def _by_site(nodes: DataFrame, edges: DataFrame, run: Callable, schema: str) -> DataFrame:
    return nodes.groupBy("site").cogroup(edges.groupBy("site")).applyInPandas(run, schema)


def _positions(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    index = pd.Index(nodes["url"])
    a, b = index.get_indexer(edges["source"]), index.get_indexer(edges["target"])
    ok = (a >= 0) & (b >= 0)
    return a[ok], b[ok]


def _pagerank_site(damping: float, rounds: int) -> Callable:
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        n = len(nodes)
        if not n:
            return pd.DataFrame({"site": [], "url": [], "rank": []}).astype({"site": str, "url": str, "rank": float})
        a, b = _positions(nodes, edges)
        degree = np.bincount(a, minlength=n)
        rank, out = np.full(n, 1.0 / n), np.maximum(degree, 1)
        for _ in range(rounds):
            given = np.bincount(b, weights=(damping * rank / out)[a], minlength=n)
            rank = (1 - damping) / n + given + damping * rank[degree == 0].sum() / n
        return pd.DataFrame({"site": nodes["site"], "url": nodes["url"], "rank": rank})

    return run


def _pagerank_rounds(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    degree = edges.groupBy("site", "source").agg(F.count(F.lit(1)).alias("degree"))
    sizes = nodes.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    base = lookup_join(nodes, sizes, ["site"]).join(degree.withColumnRenamed("source", "url"), ["site", "url"], "left")
    state = materialize(base.withColumn("rank", 1 / F.col("n")), "rank")
    edges = materialize(edges, "edges")
    for i in range(rounds):
        share = state.where("degree is not null").select("site", F.col("url").alias("source"), (damping * F.col("rank") / F.col("degree")).alias("share"))
        given = edges.join(share, ["site", "source"]).groupBy("site", F.col("target").alias("url")).agg(F.sum("share").alias("given"))
        leak = state.groupBy("site").agg((damping * F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)) / F.max("n")).alias("leak"))
        rank = (1 - damping) / F.col("n") + F.coalesce("given", F.lit(0.0)) + F.col("leak")
        state = state.join(given, ["site", "url"], "left").join(F.broadcast(leak), "site").select("site", "url", "n", "degree", rank.alias("rank"))  # a row a large site
        if i % EVERY == EVERY - 1:
            state = materialize(state, "rank")
    return state.select("site", "url", "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40, task_rows: int = TASK_ROWS) -> DataFrame:
    """``site, url, rank``: exactly ``rounds`` rounds from equal ranks; the ranks of a site sum to 1.

    ``nodes`` (``site, url``, unique) and ``edges`` (``site, source, target``). Repeated edges count once,
    self-loops and edges with an end that is no node not at all; the rank of nodes without edges out is
    spread over all. A site without edges has equal ranks, no node gives no row.
    """
    nodes = nodes.select("site", "url")
    edges = edges.where("source <> target").select("site", "source", "target").distinct()
    edges = edges.join(nodes.withColumnRenamed("url", "source"), ["site", "source"], "left_semi").join(nodes.withColumnRenamed("url", "target"), ["site", "target"], "left_semi")
    large, some = _split(nodes, edges, task_rows)
    if some is None:
        return _by_site(nodes, edges, _pagerank_site(damping, rounds), "site string, url string, rank double")
    keep = F.broadcast(large)  # sites beyond task_rows: at most rows / task_rows
    small = _by_site(nodes.join(keep, "site", "left_anti"), edges.join(keep, "site", "left_anti"), _pagerank_site(damping, rounds), "site string, url string, rank double")
    return small.unionByName(_pagerank_rounds(nodes.join(keep, "site", "left_semi"), edges.join(keep, "site", "left_semi"), damping, rounds))


def _depth_site(starts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if not len(starts):
        return pd.DataFrame({"site": [], "url": [], "depth": []}).astype({"site": str, "url": str, "depth": np.int32})
    urls = pd.Index(pd.unique(pd.concat([starts["url"], edges["source"], edges["target"]])))
    a, b = urls.get_indexer(edges["source"]), urls.get_indexer(edges["target"])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(len(urls) + 1))
    depth = np.full(len(urls), -1, np.int32)
    front, level = urls.get_indexer(starts["url"]), 0
    depth[front] = 0
    while len(front):
        level += 1
        reach = np.concatenate([b[first[u] : first[u + 1]] for u in front]) if len(front) else front
        front = np.unique(reach[depth[reach] < 0])
        depth[front] = level
    got = depth >= 0
    return pd.DataFrame({"site": starts["site"].iloc[0], "url": urls[got], "depth": depth[got]})


def _depth_rounds(starts: DataFrame, edges: DataFrame) -> DataFrame:
    edges = materialize(edges, "edges")
    front = materialize(starts.select("site", "url").distinct(), "front")
    seen, level = front.withColumn("depth", F.lit(0)), 0
    while front.limit(1).count():
        level += 1
        reach = edges.join(front.withColumnRenamed("url", "source"), ["site", "source"], "left_semi").select("site", F.col("target").alias("url")).distinct()
        front = materialize(reach.join(seen, ["site", "url"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("depth", F.lit(level)))
        if level % EVERY == 0:
            seen = materialize(seen, "seen")
    return seen


def depths(starts: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``site, url, depth``: fewest steps from a start along the edges. What cannot be reached has no row; cycles and
    repeated edges do no harm; a start without edges has depth 0."""
    starts, edges = starts.select("site", "url").distinct(), edges.select("site", "source", "target").distinct()
    schema = "site string, url string, depth int"
    large, some = _split(starts, edges, task_rows)
    if some is None:
        return _by_site(starts, edges, _depth_site, schema)
    keep = F.broadcast(large)
    small = _by_site(starts.join(keep, "site", "left_anti"), edges.join(keep, "site", "left_anti"), _depth_site, schema)
    return small.unionByName(_depth_rounds(starts.join(keep, "site", "left_semi"), edges.join(keep, "site", "left_semi")))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``site, url, label``: connected components of undirected ``pairs`` (``site, a, b``), named by their least member.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes: the rounds grow with the
    logarithm of the size, no component stands in one task. Members without a pair have no row.
    """
    ab = pairs.where("a <> b").select("site", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(ab, "components")
    before = None
    for _ in range(most_rounds):
        both = state.select("site", "u", "v").unionByName(state.select("site", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("site", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["site", "u"]).where("v > u").select("site", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("site", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["site", "u"]).select("site", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = materialize(small.unionByName(least.select("site", "u", F.col("m").alias("v"))).distinct(), "components")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("site", "u", "v"))).first()
        if now == before:
            break
        before = now
    members = state.select("site", F.col("u").alias("url"), F.col("v").alias("label"))
    return members.unionByName(members.select("site", F.col("label").alias("url"), "label").distinct())
