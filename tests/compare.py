"""Runs every query beside its SQL; also usable as a script: compare.py DIR [names]."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def difference(df, con, sql) -> str | None:
    got_names, got = spark_rows(df)
    want_names, want = sql_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {str(a)[:600]}\n  expected {str(b)[:600]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from adhere import session
    folder, only = sys.argv[1], sys.argv[2:]
    spark = session.build(8, 8)
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("COMPARE_ZONE", "UTC"))
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            msg = difference(q(spark, folder), con, sqls[name]) if name in sqls else "no sql"
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__} {str(e)[:700]}"
        bad += msg is not None
        print(f"{name:32s} {time.time() - t0:6.2f}s {'ok' if msg is None else msg}", flush=True)
    print("bad", bad)
