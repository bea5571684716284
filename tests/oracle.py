"""Runs registered queries and compares them with their SQL: python tests/oracle.py [sf] [name part ...]"""
import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TESTDATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return canon([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, sf, q):
    """(rows, message): the message is empty when both sides agree."""
    from annolytics.plans.registry import Tables
    cols, rows = spark_rows(q.build(Tables(spark, f"{TESTDATA}/{sf}")))
    if not q.sql:
        return len(rows), ""
    cols2, rows2 = sql_rows(con, q.sql)
    if cols != cols2:
        return len(rows), f"columns {cols} != {cols2}"
    if rows != rows2:
        a, b = set(map(repr, rows)), set(map(repr, rows2))
        return len(rows), (f"{len(rows)} rows against {len(rows2)}; {cols}\n   only spark {sorted(a - b)[:3]}"
                           f"\n   only sql   {sorted(b - a)[:3]}")
    types = [(c, type(v).__name__, type(w).__name__) for c, v, w in zip(cols, rows[0], rows2[0])
             if v is not None and w is not None and type(v) is not type(w)] if rows else []
    return len(rows), f"types {types}" if types else ""


if __name__ == "__main__":
    from annolytics.plans import load_queries
    from annolytics.session import local_session
    sf, wanted = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    spark, con, bad = local_session(8), connect(sf), []
    for name, q in load_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            n, message = compare(spark, con, sf, q)
        except Exception as e:
            n, message = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        if message:
            bad.append(name)
        print(f"{'BAD ' if message else 'ok  ' if q.sql else 'rows'} {name} {n} rows {time.time() - began:.1f}s {message}", flush=True)
    print("failed:", bad)
