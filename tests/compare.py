"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "~"
        if isinstance(v, int | float | Decimal | np.number) and not isinstance(v, bool | np.bool_):
            return f"{float(v):.4f}" if v else "0.0000"
        if type(v).__name__ == "date":
            return f"{v} 00:00:00"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def difference(spark_df, oracle: pd.DataFrame) -> str | None:
    """What differs, or None."""
    own = spark_df.toPandas()
    if sorted(own.columns) != sorted(oracle.columns):
        return f"columns {sorted(own.columns)} against {sorted(oracle.columns)}"
    a, b = canonical(own), canonical(oracle)
    if a != b:
        here, there = set(a), set(b)
        return f"{len(a)} rows against {len(b)}; only here: {sorted(here - there)[:3]}; only there: {sorted(there - here)[:3]}"
    numeric = [c for c in own.columns if len(own) and not own[c].isna().any() and own[c].dtype.kind in "iuf"]
    kinds = [(c, own[c].dtype, oracle[c].dtype) for c in numeric if str(own[c].dtype).lower() != str(oracle[c].dtype).lower()]
    return f"types {kinds}" if kinds else None
