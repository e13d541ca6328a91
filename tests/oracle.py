"""Compare a registered query with its SQL in DuckDB: rows, columns and values, whatever the order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differ(df, con, sql):
    """None if equal, else what differs."""
    rel = con.sql(sql)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows, SQL {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} of {len(a[1])} rows, e.g. {bad[0]}" if bad else None
