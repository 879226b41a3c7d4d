"""Run a registered query and its SQL side by side; usable as a script: oracle.py sf name..."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = os.environ.get("METALINT_TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return v

    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf: str, con=None) -> dict:
    from metalint.plans.catalogue import ORACLES, QUERIES

    start = time.time()
    df = QUERIES[name](spark, f"{DATA}/sf{sf}")
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    out = {"name": name, "rows": len(got), "spark_s": round(spark_s, 2)}
    if name not in ORACLES:
        return {**out, "ok": True, "oracle": False}
    con = con or connect(sf)
    start = time.time()
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    out["duck_s"] = round(time.time() - start, 2)
    out["oracle"] = True
    out["cols"] = sorted(cols) == sorted(df.columns)
    if not out["cols"]:
        return {**out, "ok": False, "diff": (sorted(cols), sorted(df.columns))}
    a, b = _rows(df.columns, got), _rows(cols, want)
    out["ok"] = a == b
    if not out["ok"]:
        out["diff"] = {"columns": sorted(cols), "only_spark": list((a - b).items())[:4], "n_spark": len(got),
                       "only_sql": list((b - a).items())[:4], "n_sql": len(want)}
    return out


if __name__ == "__main__":
    from metalint.plans.catalogue import QUERIES
    from metalint.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    bad = []
    for name in names or list(QUERIES):
        try:
            res = compare(spark, name, sf, con)
        except Exception as error:  # noqa: BLE001
            res = {"name": name, "ok": False, "error": str(error)[:1500]}
        print(res, flush=True)
        if not res["ok"]:
            bad.append(name)
    print("FAILED", bad)
