"""Every registered library query runs on the smallest tables and equals its SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__
from tracelake.plans import further_queries, more_queries  # noqa: F401
from tracelake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    assert got
    if name in ORACLE_SQL:
        result = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
