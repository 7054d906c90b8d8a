"""Compare queries with their SQL: python check.py [names...] (CHECK_SF=0.01)."""
from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

import catalog
from docsift.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) for one query."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL, {took:.1f}s {got[0] if got else ''}"[:230]
    t = time.time()
    rel = con.sql(sql)
    names, want = rel.columns, rel.fetchall()
    duck = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {df.columns} vs {names}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows, {took:.1f}s, duck {duck:.1f}s"
    gone, extra = sorted(set(b) - set(a))[:2], sorted(set(a) - set(b))[:2]
    return False, f"{len(a)} vs {len(b)} rows; {len(set(b) - set(a))} differ; only SQL {gone}; only Spark {extra}"


def main(argv):
    sf_dir = f"/root/testdata/sf{os.environ.get('CHECK_SF', '0.01')}"
    modules = [a[1:] for a in argv if a.startswith("@")]
    names = [a for a in argv if not a.startswith("@")]
    if modules:
        for m in modules:
            importlib.import_module(f"catalog.{m}")
    else:
        catalog.load()
    wanted = names or [
        k for k, f in catalog.QUERIES.items() if not modules or f.__module__.split(".")[-1] in modules
    ]
    spark = local_session("check", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for n in wanted:
        try:
            ok, msg = compare(spark, con, n, catalog.QUERIES[n], catalog.ORACLES.get(n), sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e).strip()[:300]} {[l for l in str(e).splitlines() if "Error" in l][-1:]}".replace("\n", " ")
        print(("ok   " if ok else "FAIL ") + n, msg, flush=True)
        bad += [] if ok else [n]
    print(f"{len(wanted) - len(bad)} of {len(wanted)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
