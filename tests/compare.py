"""Run catalog queries on Spark and their SQL on DuckDB and compare the rows.

``python tests/compare.py [folder] [query ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    """DuckDB with the tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return value
    return value if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    """'' if both sides agree, else a short report."""
    frame = query(spark, folder)
    mine = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(set(frame.columns) ^ set(names))}"
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        keyed = sorted(names)
        show = lambda c: [dict(zip(keyed, r)) for r in list(c)[:2]]
        return f"rows {mine.total()} / {theirs.total()}, only here {a.total()} {show(a)}, only there {show(b)}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from cohortspark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                report = compare(spark, con, query, sql[name], folder)
            else:
                report = "" if (n := query(spark, folder).count()) else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:  # noqa: BLE001
            report = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(report)
        print(f"{'ok  ' if not report else 'FAIL'} {name} {time.time() - start:.2f}s {report}", flush=True)
    print("failures:", bad)
