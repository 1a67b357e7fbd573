"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(spark, name: str, sf_dir: str, made, sql: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(sql).df(), made(spark, sf_dir).toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)}, not {sorted(want.columns)}"
    if len(want) != len(got):
        return f"{name}: {len(got)} rows, not {len(want)}"
    rows = [sorted(tuple("" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (want, got)]
    bad = [(a, b) for a, b in zip(*rows, strict=True) if a != b]
    return f"{name}: {len(bad)} rows differ, first {bad[0]}" if bad else ""
