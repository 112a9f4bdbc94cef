"""Every query with a SQL twin against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return str(v)


def core():
    from loomlake.plans.registry import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", core())
def test_query_equals_its_sql(spark, con, name):
    frame = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
