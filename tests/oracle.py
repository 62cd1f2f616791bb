"""Runs registered queries against DuckDB and compares rows, column names and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    names = df.columns
    mine = df.collect()
    took = time.time() - start
    if sql is None:
        return "no sql", len(mine), took, 0.0
    start = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    sql_took = time.time() - start
    if sorted(cols) != sorted(names):
        return f"columns differ {names} {cols}", len(mine), took, sql_took
    order = sorted(names)
    a = sorted((tuple(canon(r[c]) for c in order) for r in mine), key=repr)
    at = [cols.index(c) for c in order]
    b = sorted((tuple(canon(r[i]) for i in at) for r in theirs), key=repr)
    if a != b:
        seen_a, seen_b = set(a), set(b)
        extra = [x for x in a if x not in seen_b][:2]
        missing = [x for x in b if x not in seen_a][:2]
        return f"differs: {len(a)} vs {len(b)} rows\n   mine {str(extra)[:700]}\n   sql  {str(missing)[:700]}", len(mine), took, sql_took
    return "ok", len(mine), took, sql_took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from sievework.session import local_session

    sf = sys.argv[1]
    want = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    sqls = oracle_sql()
    for qname, qfn in queries().items():
        if want and not any(qname == w or (w.endswith("*") and qname.startswith(w[:-1])) for w in want):
            continue
        try:
            res, n, t1, t2 = compare(spark, con, qname, qfn, sqls.get(qname), sf)
        except Exception as e:  # report and go on
            res, n, t1, t2 = "ERROR " + str(e)[:900], -1, 0, 0
        print(f"{qname:32s} rows={n:7d} spark={t1:6.2f}s sql={t2:6.2f}s {res}", flush=True)
