"""Compare a query with its SQL in DuckDB, the way the driver does: rows, columns and values in any order."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def table(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].itertuples(index=False):
        rows.append(tuple(None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else str(pd.Timestamp(x).date()) if hasattr(x, "year") else x for x in row))
    return [tuple(columns), *sorted(rows, key=repr)]


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str:
    a, b = table(got), table(wanted)
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a) - 1} and {len(b) - 1} rows; only got {only_a[:2]}; only wanted {only_b[:2]}"
