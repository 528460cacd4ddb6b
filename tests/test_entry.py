"""The driver's contract: entry() gives rows, every query runs at the smallest scale and has its SQL's columns."""

import os

import duckdb
import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_entry_gives_rows(spark):
    got = e.entry(spark)
    assert got.columns == ["site", "term", "weight", "rk"] and got.count() > 0


def test_sql_stands_for_known_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["shared_terms", "link_outcomes", "degrees", "click_depth", "pagerank", "sections", "ambiguous_anchors", "page_cards", "passage_scores", "citability", "jsonld_types", "crawler_access", "url_normalise"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    got, want = e.queries()[name](spark, SMALL).toPandas(), db.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
