"""The queries of the subpackage against their SQL, and over empty tables and tables of NULLs."""

import glob
import os

import duckdb
import pytest

from kestrel.llm import queries
from verify import rows as compared

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, D)
    r = con.execute(queries.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert compared(df.columns, [tuple(x) for x in df.collect()]) == compared(cols, r.fetchall())


@pytest.mark.parametrize("rows", [0, 2])
def test_empty_and_null_tables(spark, tmp_path, rows):
    for p in glob.glob(f"{D}/*.parquet"):
        t = spark.read.parquet(p)
        df = spark.createDataFrame([tuple(None for _ in t.columns)] * rows, ", ".join(f"`{n}` {k}" for n, k in t.dtypes))
        for extra in ("value", "look", "own", "ids", "v", "shard", "pivot", "group_id", "kind_", "what", "fixed"):
            if extra not in df.columns:
                df = df.selectExpr("*", f"1 AS {extra}")
        df.write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    for name, q in queries.QUERIES.items():
        kept = rows if name in ("p8_ids", "p8_text", "p10_text") else 0  # one row a document
        assert q(spark, str(tmp_path)).count() == kept, name
