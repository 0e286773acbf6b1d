"""Compare registered queries with their SQL texts: python tests/check.py [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def kind(v):
    return type(v).__name__


def compare(spark_df, con, sql):
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t0 = time.time()
    srows = spark_df.collect()
    dt = time.time() - t0
    scols = spark_df.columns
    if sorted(scols) != sorted(dcols):
        return f"COLS {sorted(set(scols) ^ set(dcols))}", dt, len(srows)
    cols = sorted(scols)
    si, di = [scols.index(c) for c in cols], [dcols.index(c) for c in cols]
    a = [tuple(norm(x[i]) for i in si) for x in srows]
    b = [tuple(norm(x[i]) for i in di) for x in drows]
    if len(a) != len(b):
        return f"ROWS spark {len(a)} sql {len(b)}", dt, len(a)
    for j, c in enumerate(cols):
        ka = {kind(x[j]) for x in a if x[j] is not None}
        kb = {kind(x[j]) for x in b if x[j] is not None}
        if ka and kb and ka != kb:
            return f"TYPE {c} {ka} {kb}", dt, len(a)
    key = lambda t: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) for x in t)
    if set(a) == set(b) and sorted(a, key=str) == sorted(b, key=str):
        allnull = [c for j, c in enumerate(cols) if all(x[j] is None for x in a)]
        return "ok" + (f" NULLS {allnull}" if allnull else "") + ("" if a else " EMPTY"), dt, len(a)
    a.sort(key=key)
    b.sort(key=key)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    x, y = bad[0]
    diff = [(c, x[j], y[j]) for j, c in enumerate(cols) if x[j] != y[j]]
    return f"VALUES {len(bad)}/{len(a)} key={x[:6]} first: {diff[:4]}", dt, len(a)


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    if names and names[0].startswith("@"):
        mod = names[0][1:]
        names = [k for k in qs if e.module_of(k) == mod]
    bad = 0
    for k in names or qs:
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            if k in os_:
                res, dt, n = compare(df, con, os_[k])
            else:
                n = len(df.collect())
                res = "rows-only"
        except Exception as ex:  # noqa: BLE001
            res, n = "ERR " + str(ex).split("JVM stacktrace")[0][:900], -1
        total = time.time() - t0
        flag = res.startswith(("ok", "rows"))
        bad += not flag
        print(f"{'  ' if flag else '!!'} {k:38s} {n:7d} {total:6.2f}s {res}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
