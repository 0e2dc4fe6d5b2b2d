"""Compare a query with its SQL counterpart: row count, column names, kinds of types, values."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _spark_kind(name: str) -> str:
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if name in ("float", "double"):
        return "float"
    return {"string": "text", "boolean": "bool"}.get(name, name)


def _duck_kind(name: str) -> str:
    if name in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT"):
        return "int"
    if name in ("FLOAT", "DOUBLE"):
        return "float"
    return {"VARCHAR": "text", "BOOLEAN": "bool"}.get(name, name.lower())


def _value(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return repr(x)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; empty when both agree."""
    names = sorted(df.columns)
    description = [(r[0], r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()]
    kinds = {n: _duck_kind(t) for n, t in description}
    if sorted(kinds) != names:
        return [f"columns {names} against {sorted(kinds)}"]
    out = [
        f"type of {n}: {t} against {kinds[n]}" for n, t in df.dtypes if _spark_kind(t) != kinds[n]
    ]
    left = sorted(tuple(_value(r[n]) for n in names) for r in df.collect())
    order = [n for n, _ in description]
    right = sorted(
        tuple(_value(row[order.index(n)]) for n in names) for row in con.execute(sql).fetchall()
    )
    if len(left) != len(right):
        out.append(f"{len(left)} rows against {len(right)}")
    if left != right:
        l, r = set(left), set(right)
        out.append(f"only here: {sorted(l - r)[:3]}; only there: {sorted(r - l)[:3]}")
    return out
