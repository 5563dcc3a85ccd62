"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__
from marlstone import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_paging_is_a_top_k(spark):
    e = catalogue.engine(spark, SF)
    plan = e.from_("orders").where("o_orderpriority", "eq", "1-URGENT").order_by("slug").lines()._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan and "Exchange" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
