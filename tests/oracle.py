"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    expected = con.execute(sql)
    expected_columns = [d[0] for d in expected.description]
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} vs {sorted(expected_columns)}"
    want = rows(expected_columns, expected.fetchall())
    got = rows(df.columns, df.collect())
    if len(want) != len(got):
        missing = set(want) - set(got)
        extra = set(got) - set(want)
        return f"{len(got)} rows, expected {len(want)}; extra {list(extra)[:2]}; missing {list(missing)[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"got {a}\nexpected {b}"
    return None
