"""Side-by-side comparison of catalog queries with their SQL."""

import math

import duckdb
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(frame, con, statement: str) -> str | None:
    """None when both sides agree, else what differs."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    off = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(off)} rows differ, first: {off[0]}" if off else None
