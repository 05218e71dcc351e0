"""Runs a registered query and its SQL check side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if math.isinf(v) else round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    return v


FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "float": "FLOAT",
}


def compare(spark, sf_dir: str, fn, sql: str, con=None) -> str | None:
    """None when equal, else a description of the first difference."""
    con = con or connect(sf_dir)
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    for c, t in df.dtypes:
        if t in FAMILY and FAMILY[t] != types[c]:
            return f"type of {c}: {t} vs {types[c]}"
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in want_rows), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; extra {[g for g in got if g not in want][:2]}; missing {[w for w in want if w not in got][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {cols}, first {bad[0]!r:.700}"
    if not got:
        return "no rows"
    return None
