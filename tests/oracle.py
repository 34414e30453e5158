"""Compares a query with its SQL in DuckDB: rows as sorted tuples, columns by name, doubles to 5 places."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 5) + 0.0
    return v


def _sorted(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both agree; else what differs."""
    rel = con.execute(sql)
    names, rows = [c[0] for c in rel.description], rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = _sorted(spark_df.columns, [tuple(r) for r in spark_df.collect()]), _sorted(names, rows)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    kinds = [(x, y) for x, y in zip(a, b, strict=True) if not all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-7, abs_tol=2e-5) for p, q in zip(x, y, strict=True))]
    return f"{len(kinds)} rows differ: {kinds[:2]}" if kinds else ""
