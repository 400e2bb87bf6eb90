"""Every core query that SQL can state, against that SQL in DuckDB, over whole tables; and odd tables for the dealt ones."""

import glob
import os

import duckdb
import pytest

from kestrel import catalog
from verify import rows as compared

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    r = duck.execute(catalog.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert compared(df.columns, [tuple(x) for x in df.collect()]) == compared(cols, r.fetchall())


def odd_tables(spark, folder, rows):
    """Copies of all tables with no row, or with one of NULLs only, and columns that clash with the operators' own."""
    for p in glob.glob(f"{D}/*.parquet"):
        t = spark.read.parquet(p)
        df = spark.createDataFrame([tuple(None for _ in t.columns)] * rows, t.schema.fromDDL(", ".join(f"`{n}` {k}" for n, k in t.dtypes)))
        for extra in ("value", "key", "n", "a", "b", "c", "group_id", "leaf", "own", "item", "source_"):
            if extra not in df.columns:
                df = df.selectExpr("*", f"1 AS {extra}")
        df.write.parquet(f"{folder}/{os.path.basename(p)}")
    return str(folder)


@pytest.mark.parametrize("rows", [0, 2])
def test_dealt_queries_take_empty_and_null_tables(spark, tmp_path, rows):
    d = odd_tables(spark, tmp_path, rows)
    for name in ("p3_found", "p5_found", "pets", "near_texts", "person_rebuild", "dup_groups", "dup_breakdown", "place_groups", "regions_of_places", "nms", "collapsed_views"):
        assert catalog.QUERIES[name](spark, d).count() == 0, name
