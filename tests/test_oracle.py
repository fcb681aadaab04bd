"""Every catalogue query with a SQL twin gives the same rows in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from timbral.plans import catalogue, extras, further, listed, modelling, proved  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    columns = sorted(df.columns)
    shown = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = rows(catalogue.queries()[name](spark, SF).toPandas().astype(object))
    want = rows(duck.execute(catalogue.oracle_sql()[name]).df().astype(object))
    assert got == want
