"""Queries against their SQL twins on small tables of the cases the test data lacks."""

import datetime as dt
import hashlib
import re

import duckdb
import pandas as pd

from compare import difference
from instants import T0, at
from pitbars.operators import metrics
from pitbars.operators.ledger import equity_curve
from pitbars.plans.oracles import ORACLES, H, performance_sql
from pitbars.plans.queries import QUERIES, rounded
from pitbars.sources.digests import digest


def differs(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        path = f"{folder}/{table}.parquet"
        frame.astype({c: "datetime64[us]" for c in frame if frame[c].dtype.kind == "M"}).to_parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return difference(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def test_stream_findings_of_bars_with_a_zero_price(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, begin + dt.timedelta(minutes=20 * i), i, "view", 0.0 if i == 4 else 5.0 + i, '{"k": 3}') for i in range(20)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    assert differs(spark, tmp_path, "stream_findings", events=events) is None


def test_size_targets_with_a_mark_on_half_a_cent(spark, tmp_path):
    day = dt.datetime(1996, 1, 1)
    idle = [(4 + 5 * i, 21, "O", 50_000.0, day, "1-URGENT") for i in range(59)]
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    orders = pd.DataFrame([(1, 8, "O", 77_195.0, day, "1-URGENT"), *idle], columns=columns)
    assert differs(spark, tmp_path, "size_targets", orders=orders) is None
    (asked,) = QUERIES["size_targets"](spark, str(tmp_path)).where("instrument_id = '8|1'").collect()
    assert asked["final_quantity"] == 1378.0


def test_an_account_that_holds_nothing_has_no_exposure(spark):
    kinds = ("instrument_id STRING, side STRING, quantity DOUBLE, fill_at TIMESTAMP, fill_no INT, "
             "reference_price DOUBLE, price DOUBLE, fee DOUBLE")
    rows = [(n, s, q, at(m), 0, p, p, 0.0) for n, s, q, m, p in [
        ("X", "buy", 0.1, 1, 10.1), ("Y", "buy", 0.7, 1, 3.3), ("X", "sell", 0.1, 3, 10.7), ("Y", "sell", 0.7, 3, 3.7)]]
    marks = [(n, at(m), p) for n, m, p in [
        ("X", 2, 10.3), ("Y", 2, 3.1), ("X", 4, 11.0), ("Y", 4, 3.9), ("X", 64, 11.0), ("X", 124, 11.0)]]
    marks = spark.createDataFrame(marks, "instrument_id STRING, at TIMESTAMP, price DOUBLE")
    curve = equity_curve(
        spark.createDataFrame(rows, kinds), marks, initial_cash=1000.0, fill_order=["fill_at", "fill_no"])
    flat = curve.where("position_count = 0").collect()
    assert len(flat) == 4
    assert all(r.gross_exposure == 0 and r.net_exposure == 0 and r.equity == r.cash for r in flat)


def test_performance_of_accounts_in_debt_equals_its_sql(spark):
    equity = {
        "sound": [100.0, 110.0, 105.0], "begins": [-50.0, 20.0, 30.0], "ends": [50.0, 10.0, -20.0],
        "debt": [-10.0, -30.0, -20.0], "once": [70.0], "idle": [80.0, 80.0 + 1e-12, 80.0 - 1e-12],
    }
    rows = [(name, T0 + dt.timedelta(hours=n), e, 10.0, 5.0) for name, all_ in equity.items() for n, e in enumerate(all_)]
    curve = spark.createDataFrame(
        rows, "name STRING, at TIMESTAMP, equity DOUBLE, gross_exposure DOUBLE, net_exposure DOUBLE")
    made = metrics.performance(curve, keys=["name"], bar_size="1h", annualization=metrics.Annualization(10.0, "test"))
    shown = ["name", "periods", "start_equity", "end_equity", "total_return", "annualized_return",
             "annualized_volatility", "sharpe", "avg_gross_exposure", "avg_net_exposure", "period_hit_rate"]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(
        [(n, w.replace(tzinfo=None), *e) for n, w, *e in rows], columns=curve.columns))
    sql = f"WITH curve AS (SELECT * REPLACE (CAST(\"at\" AS TIMESTAMP) AS \"at\") FROM frame), {performance_sql('name', H, 10.0, solvent=False)} SELECT * FROM perf"
    sql = re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', sql)
    doubles = ", ".join(f"round({c} * 1e6 + 0.0137) / 1e6 + 0.0 AS {c}" for c in shown[2:])
    assert difference(rounded(made.select(*shown)), con, f"SELECT name, periods, {doubles} FROM ({sql})") is None


def test_money_of_the_metric_row_is_in_cents(spark):
    made = spark.createDataFrame([(-127423292.442194, 0.123456789)], "end_equity DOUBLE, total_return DOUBLE")
    other = spark.createDataFrame([(-127423292.442193, 0.123456789)], made.schema)
    shown = [rounded(rounded(df, 2, ["end_equity"])).first() for df in (made, other)]
    assert shown[0] == shown[1] == (-127423292.44, 0.123457)


def test_digest_is_the_exact_sum_of_hash_slices(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS v")
    made = digest(df, ["v"], keys=["k"])
    for row in made.collect():
        hashes = [hashlib.sha256(str(v).encode()).hexdigest() for v in range(500) if v % 3 == row["k"]]
        assert row["rows"] == len(hashes)
        assert row["low"] == sum(int(h[:15], 16) for h in hashes)
        assert row["high"] == sum(int(h[15:30], 16) for h in hashes)
