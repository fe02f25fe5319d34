"""Spark results against DuckDB, or row lists, without regard to order."""

import os

import duckdb
import pandas as pd


def rows(records):
    def value(v):
        return round(v, 6) if isinstance(v, float) else v.hex() if isinstance(v, bytes | bytearray) else str(v)

    return sorted((tuple((k, value(r[k])) for k in sorted(r)) for r in records), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, sql, sf_dir):
    frame = duck(sf_dir).execute(sql).df()
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else v.item() if hasattr(v, "item") else v
    theirs = [{c: plain(v) for c, v in zip(frame.columns, r, strict=True)} for r in frame.itertuples(index=False)]
    ours = [r.asDict() for r in df.collect()]
    assert rows(ours) == rows(theirs)
