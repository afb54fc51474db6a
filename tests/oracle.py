"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return ""
    if type(v).__name__ == "Decimal" or isinstance(v, float):
        return repr(round(float(v), 6))
    return str(int(v)) if type(v).__name__ in ("int", "int64", "int32", "bool", "bool_") else str(v)


def rows(df: pd.DataFrame):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    got, want = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
