"""Every query of the registry gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__
from kinweave.plans import branches  # noqa: F401
from kinweave.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    at = [cols.index(c) for c in sorted(df.columns)]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
