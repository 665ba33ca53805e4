"""Compare registered queries with their SQL on one data directory: ``python tests/check_oracle.py DIR [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v or 0) if not isinstance(v, str) else (False, "s", v) for v in r))


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b


def compare(spark, con, sf_dir, name, build, sql) -> str:
    start = time.time()
    df = build(spark, sf_dir)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows {len(ours[1])} ({spent:.1f}s)"
    start = time.time()
    got = con.execute(sql)
    theirs = table([d[0] for d in got.description], got.fetchall())
    sql_spent = time.time() - start
    if ours[0] != theirs[0]:
        return f"MISMATCH columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"MISMATCH rows {len(ours[1])} / {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(*[ours[1], theirs[1]]) if not all(map(close, a, b))]
    if bad:
        return f"MISMATCH {len(bad)} of {len(ours[1])}: {str(bad[0][0])[:400]} / {str(bad[0][1])[:400]}"
    return f"ok {len(ours[1])} rows ({spent:.1f}s, sql {sql_spent:.1f}s)"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sql = connect(sf_dir), e.oracle_sql()
    for name, build in e.queries().items():
        if names and name not in names:
            continue
        try:
            print(name, compare(spark, con, sf_dir, name, build, sql.get(name)), flush=True)
        except Exception as problem:  # noqa: BLE001
            print(name, "ERROR", type(problem).__name__, str(problem)[:600].replace("\n", " "), flush=True)
    print("without SQL:", sorted(set(e.queries()) - set(sql)), "unknown SQL:", sorted(set(sql) - set(e.queries())))
