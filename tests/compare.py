"""Compare every query with its oracle; usable as a script and from pytest.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not hasattr(v, "hour") else v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    began = time.time()
    df = query(spark, sf_dir)
    types = dict(df.dtypes)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return took, len(got), "rows only", types
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    duck_types = {c[0]: str(c[1]) for c in cur.description}
    want_cols, want = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return took, len(got), f"columns {got_cols} != {want_cols}", types
    if len(got) != len(want):
        return took, len(got), f"{len(got)} rows != {len(want)}", types
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return took, len(got), f"{len(bad)} rows differ {got_cols}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", types
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}
    odd = {c: (t, duck_types[c]) for c, t in types.items() if pairs.get(t) != duck_types[c]}
    return took, len(got), "ok" if not odd else f"types {odd}", types


def main(argv):
    import __spark_entry__ as entry
    from terrahaz.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    picked = argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.sql.mapKeyDedupPolicy": "EXCEPTION"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if picked and not any(p in name for p in picked):
            continue
        try:
            took, n, state, _ = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # report and go on
            took, n, state = 0.0, -1, f"error {str(error)[:1500]}"
        failed += state not in ("ok", "rows only")
        print(f"{name:34s} {took:6.2f}s {n:8d} {state}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
