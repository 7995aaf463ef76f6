"""Run registered queries and their SQL side by side: python tests/check_queries.py [sf dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6)
        return int(value) if value == int(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_integer_ratio"):
        return plain(float(value)) if not isinstance(value, int) else value
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf):
    started = time.time()
    df = query(spark, sf)
    got = df.collect()
    spent = time.time() - started
    if sql is None:
        return "rows only", len(got), spent, ""
    started = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    spent_sql = time.time() - started
    g, w = rows_of(df.columns, got), rows_of([d[0] for d in cur.description], want)
    if g == w:
        return "match", len(got), spent, f"sql {spent_sql:.1f}s"
    if g[0] != w[0]:
        return "COLUMNS", len(got), spent, f"{g[0]} {w[0]}"
    gs, ws = set(map(repr, g[1])), set(map(repr, w[1]))
    return "DIFFER", len(got), spent, f"spark {len(g[1])} sql {len(w[1])}\n  spark only {[x[:300] for x in sorted(gs - ws)[:2]]}\n  sql only {[x[:300] for x in sorted(ws - gs)[:2]]}"


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main(argv):
    import __spark_entry__ as entry
    from sheavework.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            state, n, spent, note = compare(spark, con, name, query, oracles.get(name), sf)
        except Exception as problem:  # noqa: BLE001
            state, n, spent, note = "ERROR", 0, 0.0, f"{type(problem).__name__} {str(problem)[:700]}"
        if state not in ("match", "rows only"):
            failed.append(name)
        print(f"{name:32s} {state:10s} {n:8d} rows {spent:6.1f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
