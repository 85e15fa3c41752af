"""Run a query and its oracle and compare the rows exactly."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (0.0 if x == 0 else x)
    return x


def ordered(rows, names):
    idx = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in idx) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r)), [names[i] for i in idx]


def mismatch(df, sql: str, con) -> str | None:
    got, gn = ordered([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want, wn = ordered(cur.fetchall(), names)
    if gn != wn:
        return f"columns {gn} != {wn}"
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}
    off = [(c, t, types[c]) for c, t in df.dtypes if alias.get(t, t) != types[c]]
    if off:
        return f"types differ: {off}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[:2]}" if bad else None
