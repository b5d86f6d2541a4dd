"""Run catalogue queries and their SQL side by side and compare the rows.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from nearpass.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(0.0 if v == 0 else v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, key):
    """Return (message, spark seconds, rows); message is empty when all rows agree."""
    t = time.time()
    df = registry.QUERIES[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if key not in registry.SQL:
        return "", took, len(got)
    cur = con.execute(registry.SQL[key])
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(names, want)
    if gc != wc:
        return f"columns {gc} != {wc}", took, len(g)
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(n, d, types[names.index(n)]) for n, d in df.dtypes
           if kinds.get(d, d) != types[names.index(n)]]
    msg = f"types {odd}; " if odd else ""
    if g != w:
        diff_g = [r for r in g if r not in set(w)][:3]
        diff_w = [r for r in w if r not in set(g)][:3]
        n_bad = len(set(g) ^ set(w))
        msg += f"rows {len(g)} vs {len(w)}, {n_bad} differ\n   cols  {gc}\n   spark {diff_g}\n   sql   {diff_w}"
    return msg, took, len(g)


def main(argv):
    from nearpass.plans import catalog  # noqa: F401
    from nearpass.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    names = [k for k in registry.QUERIES if not argv or any(k.startswith(p) for p in argv)]
    spark, con = build_session(), oracle(sf_dir)
    bad = 0
    for key in names:
        try:
            msg, took, n = compare(spark, con, sf_dir, key)
        except Exception as err:  # shown, not hidden
            msg, took, n = f"{type(err).__name__}: {str(err)[:1500]}", 0.0, 0
        state = "ok" if not msg else "BAD"
        if not msg and key not in registry.SQL:
            state = "rows"
        if not msg and n == 0:
            state += " EMPTY"
        bad += bool(msg)
        print(f"{state:8} {key:34} {n:7d} rows {took:6.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
