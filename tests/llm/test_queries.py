"""Registered queries against their SQL."""

import duckdb
import pytest

from splatarium.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    want = want.astype({k: got[k].dtype for k in cols})
    a, b = (x[cols].astype(str).sort_values(cols, ignore_index=True) for x in (got, want))
    assert a.equals(b)
