"""Run registered queries against their oracles: check.py SF [name-part ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ; columns {got[0]}: {bad[:2]}", len(got[1])
    return None, len(got[1])


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tarnfell.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failures = 0
    for name, plan in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = None, len(df.collect())
            state = "ok" if problem is None else "DIFF"
            if name not in oracles:
                state = "rows-only"
        except Exception as error:  # noqa: BLE001
            problem, n, state = f"{type(error).__name__}: {str(error)[:900]}", 0, "ERROR"
        failures += problem is not None
        print(f"{state:9} {name:40} {n:8} {time.time() - started:6.1f}s {problem or ''}", flush=True)
    print("failures:", failures)
