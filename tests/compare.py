"""A query's rows against its SQL's, in DuckDB over the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, _ordered(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def oracle_rows(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    return cols, _ordered(tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
