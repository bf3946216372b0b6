"""Run a query and its SQL over the same tables and compare all rows."""

import os

import duckdb
import pandas as pd


def connection(sf: str):
    con = duckdb.connect()
    for table in os.listdir(sf):
        name = table.removesuffix(".parquet")
        path = f"{sf}/{table}" + ("/*.parquet" if os.path.isdir(f"{sf}/{table}") else "")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def _objects(table) -> pd.DataFrame:
    """Plain Python values, so that NaN and null stay apart."""
    return pd.DataFrame({c: pd.Series(table.column(c).to_pylist(), dtype=object) for c in table.column_names}, columns=table.column_names)


def compare(df, sql: str, con) -> None:
    got, want = _objects(df.toArrow()), _objects(con.sql(sql).to_arrow_table())
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
