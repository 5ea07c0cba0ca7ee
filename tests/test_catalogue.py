"""Every registered query that SQL can say gives the SQL's rows."""

import math
import os

import pytest

from passagework.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "documents benchmark embeddings labels conversations events orders".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert plain(rows) == plain(want)
