"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ledgerline.plans import artifacts, catalogue, context, inventory, models, report, specifications, stored, verification, versioned  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(columns) + f" from ({catalogue.SQL[name]})").fetchall()
    assert want, "no rows prove nothing"
    assert rows(df.select(*columns).collect()) == rows(want)
