"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import decimal
import math

import duckdb

from millrace.plans.base import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return f"{v:.6g}" if isinstance(v, int) and abs(v) >= 10**6 else str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def of_duckdb(con, text):
    c = con.execute(text)
    rows, given = c.fetchall(), [d[0] for d in c.description]
    names = sorted(given)
    return names, sorted(tuple(plain(r[given.index(n)]) for n in names) for r in rows)
