"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS FROM '{path}'")
    return connection


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def difference(frame, relation) -> str | None:
    """What differs between a Spark DataFrame and a DuckDB relation; None when they are equal."""
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} != {sorted(relation.columns)}"
    columns = sorted(frame.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = Counter(tuple(_plain(row[c]) for c in columns) for row in frame.collect())
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in relation.fetchall())
    if ours == theirs:
        return None
    missing, extra = theirs - ours, ours - theirs
    return (
        f"{sum(ours.values())} rows, {sum(theirs.values())} expected; columns {columns}; "
        f"missing {sum(missing.values())} {list(missing)[:2]}; extra {sum(extra.values())} {list(extra)[:2]}"
    )[:1500]
