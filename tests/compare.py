"""Run registered queries beside their check SQL and compare the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return con


def family(kind: str) -> str:
    kind = kind.lower()
    if kind in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "int"
    if kind in ("double", "float") or kind.startswith("decimal"):
        return "float"
    if kind in ("string", "varchar"):
        return "text"
    return kind


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when equal."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {r[0]: family(r[1]) for r in described}
    ours = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    problems = []
    if ours != theirs:
        problems.append(f"schema: spark {ours} sql {theirs}")
        if set(ours) != set(theirs):
            return problems
    names = sorted(ours)
    left = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    order = [r[0] for r in described]
    places = [order.index(n) for n in names]
    right = Counter(tuple(plain(r[p]) for p in places) for r in con.execute(sql).fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        problems.append(
            f"rows: spark {sum(left.values())} sql {sum(right.values())}; columns {names}\n"
            f"  only spark {sum(only_left.values())}: {list(only_left)[:2]}\n"
            f"  only sql {sum(only_right.values())}: {list(only_right)[:2]}"
        )
    if not left:
        problems.append("no rows")
    return problems
