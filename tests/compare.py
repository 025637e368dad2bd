"""Run registered queries next to their SQL and compare row by row."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if node in plan:
            return f"plan has a {node}"
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return (f"{len(got[1])} / {len(want[1])} rows\n  only spark: {sorted(a - b)[:3]}\n  only sql:   {sorted(b - a)[:3]}")


def main(folder, names):
    import __spark_entry__ as entry
    from fichaflow import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, queries[name], sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                problem, n = None, queries[name](spark, folder).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} rows={n} {'' if name in sqls else 'no sql'} {time.time() - t:.2f}s"
              + (f"\n  {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
