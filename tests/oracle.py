"""Runs a query's SQL in DuckDB on the same tables and compares values without regard to order."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x != x:
            return "NULL"
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return str(int(x)) if float(x) == int(x) else f"{float(x):.6g}"

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def expected(sql: str, directory: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def check(spark, query, sql: str, directory: str = DATA) -> None:
    got, want = query(spark, directory).toPandas(), expected(sql, directory)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
