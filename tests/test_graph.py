"""Graph algorithms: known ranks and depths, both ways of working give the same, odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph


def frames(spark, edges, nodes=None, site="s"):
    nodes = nodes or sorted({x for e in edges for x in e})
    return spark.createDataFrame([(site, n) for n in nodes], "site string, url string"), spark.createDataFrame([(site, *e) for e in edges], "site string, source string, target string")


@pytest.mark.parametrize("limit", [graph.TASK_ROWS, 0])
@pytest.mark.parametrize("edges, want", [
    ([("A", "B")], {"A": 0.350877, "B": 0.649123}),
    ([("A", "B"), ("B", "C"), ("C", "A"), ("A", "B"), ("A", "A")], {"A": 0.333333, "B": 0.333333, "C": 0.333333}),
    ([("H", "A"), ("H", "B"), ("H", "C"), ("A", "H"), ("B", "H"), ("B", "A"), ("A", "gone")], {"H": 0.374911, "A": 0.260073, "B": 0.182508, "C": 0.182508}),
])
def test_pagerank(spark, edges, want, limit):
    nodes, e = frames(spark, edges, sorted(want))
    got = {r.url: round(r["rank"], 6) for r in graph.pagerank(nodes, e, task_rows=limit).collect()}
    assert got == want


def test_pagerank_without_edges(spark):
    nodes, e = frames(spark, [], ["A", "B"])
    assert {r.url: r["rank"] for r in graph.pagerank(nodes, e).collect()} == {"A": 0.5, "B": 0.5}
    assert graph.pagerank(nodes.limit(0), e).count() == 0


def test_both_ways_agree(spark):
    rng = random.Random(3)
    sites = {s: [(f"{rng.randrange(40)}", f"{rng.randrange(40)}") for _ in range(n)] for s, n in (("hot", 400), ("cold", 12))}
    nodes = spark.createDataFrame([(s, str(i)) for s in sites for i in range(40)], "site string, url string")
    edges = spark.createDataFrame([(s, *e) for s, es in sites.items() for e in es], "site string, source string, target string")
    start = nodes.where("url = '0'")
    a, b = ({(r.site, r.url): r["rank"] for r in graph.pagerank(nodes, edges, task_rows=t).collect()} for t in (10**6, 100))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert abs(sum(v for k, v in a.items() if k[0] == "hot") - 1) < 1e-9
    a, b = ({tuple(r) for r in graph.depths(start, edges, task_rows=t).collect()} for t in (10**6, 100))
    assert a == b and ("hot", "0", 0) in a


def test_components(spark):
    rng = random.Random(5)
    pairs = [(a, a + 1) for a in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    df = spark.createDataFrame([("s", *p) for p in pairs], "site string, a bigint, b bigint")
    got = {r.url: r.label for r in graph.components(df).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert graph.components(df.limit(0)).count() == 0


def test_lookup_join_beyond_the_bound(spark):
    from corpusmill.operators.joins import lookup_join

    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, 2)], "k bigint, v bigint"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (sorted(map(str, lookup_join(big, small, ["k"], how, max_rows=m).collect())) for m in (10**6, 10))
        assert a == b
