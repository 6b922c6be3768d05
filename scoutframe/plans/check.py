"""Side-by-side run of queries and their DuckDB texts (used by the tests)."""

from __future__ import annotations

import math
from pathlib import Path

from .registry import ORACLES, QUERIES


def duckdb_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("num", value)
    if isinstance(value, int):
        return ("num", float(value))
    return ("text", str(value))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when both sides agree, otherwise a short description of the difference."""
    df = QUERIES[name](spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; columns {sorted(names)}; first {bad[0]}"
    return f"empty" if not got else None
