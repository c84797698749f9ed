import os

import pytest

from quadloom import message_queries, rule_queries  # noqa: F401
from quadloom import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = oracle.sql(f"SELECT {', '.join(names)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
