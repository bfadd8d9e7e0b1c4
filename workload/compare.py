"""Run registered queries on Spark and their SQL on DuckDB and compare rows."""

from __future__ import annotations

import glob
import os
import sys
import time


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def normal(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return round(value, 9)
    return value


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    ours = [tuple(normal(r[c]) for c in cols) for r in df.select(*cols).collect()]
    mid = time.time()
    if sql is None:
        return True, f"{name}: rows only {len(ours)} ({mid - t:.1f}s)"
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = [tuple(normal(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a, b = sorted(ours, key=key), sorted(theirs, key=key)
    took = f"({mid - t:.1f}s, sql {time.time() - mid:.1f}s)"
    if a == b:
        return True, f"{name}: ok {len(a)} rows {took}"
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    return False, f"{name}: {len(a)} vs {len(b)} rows {took}; only ours {list((ca - cb))[:2]}; only sql {list((cb - ca))[:2]}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from seepline.session import local_session
    from workload import catalog

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = catalog.load()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{name}: {type(e).__name__} {str(e)[:400]}"
        bad += not ok
        print(("" if ok else "FAIL ") + text, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
