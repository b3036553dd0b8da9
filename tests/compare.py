"""Run queries on Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _clean(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_clean(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    if len(rows) != len(other):
        return f"rows {len(rows)} vs {len(other)}"
    a, b = _sorted(rows, spark_df.columns), _sorted(other, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ over {sorted(names)}, first {bad[0]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf), oracle_sql()
    wanted = sys.argv[1:]
    failed = []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                verdict = difference(df, con, oracles[name])
            else:
                verdict = None if df.count() else "no rows"
        except Exception as error:  # the report goes on to the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        if verdict:
            failed.append(name)
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - begun:.1f}s "
              f"{verdict or ''}"[:1100], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
