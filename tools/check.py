"""Run registered queries against their DuckDB oracles: python tools/check.py [sf_dir] [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tellerlake.registry import QUERIES  # noqa: E402
from tellerlake.session import local_session  # noqa: E402

VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{folder}/{v}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (0.0 if v == 0 else v)
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, key):
    q = QUERIES[key]
    start = time.time()
    df = q(spark, folder)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - start
    if q.oracle is None:
        return ("rows-only", took, 0.0, f"{len(mine)} rows")
    start = time.time()
    cur = con.execute(q.oracle)
    names = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), names)
    oracle = time.time() - start
    if sorted(names) != sorted(df.columns):
        return ("COLUMNS", took, oracle, f"{names} {df.columns}")
    if len(mine) != len(theirs):
        return ("COUNT", took, oracle, f"{len(mine)} vs {len(theirs)} e.g. {[x for x in mine if x not in set(theirs)][:2]} / {[x for x in theirs if x not in set(mine)][:2]}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return ("VALUES", took, oracle, f"{len(bad)}/{len(mine)} {sorted(names)} {bad[:2]}")
    return ("ok" if mine else "EMPTY", took, oracle, f"{len(mine)} rows")


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    failed = []
    for key in args or QUERIES:
        try:
            result = compare(spark, con, folder, key)
        except Exception as error:
            result = ("ERROR", 0.0, 0.0, f"{type(error).__name__}: {str(error)[:600]}")
        if result[0] not in ("ok", "rows-only"):
            failed.append(key)
        print(f"{result[0]:9} {key:32} {result[1]:6.1f}s {result[2]:6.1f}s  {result[3][:900]}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
