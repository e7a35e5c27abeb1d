"""Query results against DuckDB's on the same tables."""

import numbers
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connect(sf: str):
    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
    return con


def _rows(frame, columns):
    def plain(v):
        if pd.isna(v):
            return ""
        return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


def same(spark_frame, con, sql: str) -> None:
    got, want = spark_frame.toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)
