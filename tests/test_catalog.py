"""Every registered scene query against its SQL."""

import duckdb
import pytest

from splatarium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    a, b = (x[cols].astype(str).sort_values(cols, ignore_index=True) for x in (a, b))
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string() + b[(a != b).any(axis=1)].head().to_string()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    same(got, want.astype({c: got[c].dtype for c in got.columns if c in want.columns}))


def test_interpolate_whole_table(spark):
    out = catalog.QUERIES["interpolate_tables"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_nearest_at_a_tie(spark):
    """The first center wins, whichever way the last bit of a distance falls."""
    from pyspark.sql import functions as F

    from splatarium.functions import scalar

    df = spark.createDataFrame([(0.2,), (0.45,), (0.75,), (0.46,)], "x double")
    assert [r[0] for r in df.select(scalar.nearest(F.col("x"), (0.1, 0.3, 0.6, 0.9), (1, 4, 2, 8))).collect()] == [1, 4, 2, 2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
