import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "pages", "conversations", "embeddings", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def cell(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    sql = entry.oracle_sql()[name]
    assert rows(got) == rows(con.sql(sql).to_arrow_table())
    assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
