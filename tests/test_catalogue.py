"""Every graph query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sorrel.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = [tuple(str(r[c]) for c in order) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(str(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert rows, "a query that finds nothing shows nothing"


def test_views_agree(spark, sf, con):
    from sorrel.plans.projection import VIEWS, Graph, with_views

    g = Graph(spark, sf)
    for v in VIEWS:
        got, want = g.sql(f"SELECT * FROM {v}"), con.sql(with_views("", f"SELECT * FROM {v}"))
        order = sorted(want.columns)
        assert sorted(tuple(str(r[c]) for c in order) for r in got.collect()) == sorted(tuple(str(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), v
