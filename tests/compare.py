"""Row-by-row comparison of a query with its DuckDB equivalent."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return tuple(_cell(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_columns, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} and {want_columns}"]
    out = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    a, b = set(map(repr, got)), set(map(repr, want))
    return out + [f"only ours {x}" for x in sorted(a - b)[:3]] + [f"only the oracle's {x}" for x in sorted(b - a)[:3]]
