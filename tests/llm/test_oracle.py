"""The corpus queries that SQL can express, against it."""

import os

import duckdb
import pytest

from ledgerline.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(columns) + f" from ({catalogue.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, df.select(*columns).collect())) == sorted(want)
