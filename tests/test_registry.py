"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from leafmark import oracle, queries
from leafmark.plans import query

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


def test_trees_of_the_sql_are_those_of_the_parser():
    def same(a, b):
        if isinstance(b, oracle.Term):
            return isinstance(a, query.Leaf) and (a.tokens, a.prefix) == b
        return type(a).__name__.upper() == b.kind and same(a.left, b.left) and same(a.right, b.right)

    assert all(same(query.parse(text), tree) for text, tree in oracle.TREES.items())
    assert set(queries.SEARCHES.values()) <= set(oracle.TREES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
