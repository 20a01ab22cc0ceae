"""Runs a query and its SQL on the same tables and compares all values."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def views(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    for name, kinds in {"int": ("int", "integer", "bigint", "smallint", "hugeint", "tinyint", "ubigint", "long"), "float": ("double", "float", "real"), "str": ("string", "varchar")}.items():
        if t in kinds:
            return name
    return "decimal" if t.startswith("decimal") else t


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, or nothing."""
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    ours, theirs = dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types), strict=True))
    if odd := [(c, ours[c], theirs[c]) for c in ours if kind(ours[c]) != kind(theirs[c]) and not ours[c].startswith(("array", "struct", "map"))]:
        return f"types {odd}"
    if not got or not want:
        return f"nothing to compare: {len(got)} and {len(want)} rows"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{sorted(df.columns)}: {a} is not {b}"
    return ""
