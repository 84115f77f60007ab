"""Runs registered queries beside their oracle SQL. As a script: python tests/compare.py [sf] [name part ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def check(spark, con, name, query, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    kinds = {(type(x), type(y)) for g, w in zip(got[1][:1], want[1][:1]) for x, y in zip(g, w) if x is not None and y is not None}
    odd = [k for k in kinds if k[0] is not k[1]]
    if odd:
        return f"types {odd}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}" if bad else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from zephra.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    for pair in os.environ.get("CONF", "").split():  # e.g. CONF="spark.sql.shuffle.partitions=200"
        spark.conf.set(*pair.split("="))
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name in qs:
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            problem = check(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - t0:6.2f}s {'' if name in sqls else '(rows) '}{name} {problem or ''}"[:1500], flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
