"""Rules, targets, orders, costs, sizing, ledgers, metrics: golden numbers by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from instants import at, rows_of
from pitbars.functions.rules import check_features, condition, referenced, target_weight
from pitbars.operators import execution as ex
from pitbars.operators import ledger, metrics, ordered, runs, targets
from pitbars.operators.sizing import Limits, size_targets
from pitbars.types import DAY, MINUTE

UTC = dt.timezone.utc


def test_missing_features_are_false_and_nan_compares_like_floats(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan"))], "id INT, x DOUBLE")
    leaf = lambda op, v=1.0: {"feature": "x", "op": op, "value": v}
    got = df.select(
        "id", condition(leaf(">")).alias("gt"), condition({"not": leaf(">")}).alias("no"),
        condition(leaf("!=", 2.0)).alias("ne"),
    )
    assert rows_of(got, "id") == [(1, True, False, False), (2, False, True, False), (3, False, True, True)]
    both = {"all_of": [leaf(">"), {"feature": "x", "op": "<", "other": "id"}]}
    assert referenced(both) == {"x", "id"}
    with pytest.raises(ValueError):
        condition({"feature": "x", "op": ">", "value": 1, "other": "y"})
    with pytest.raises(ValueError, match="do not have"):
        check_features(df, {"long_when": {"feature": "nope", "op": ">", "value": 0}})


def test_long_takes_precedence(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "x DOUBLE")
    rule = {"long_when": {"feature": "x", "op": ">=", "value": 1}, "short_when": {"feature": "x", "op": "!=", "value": 0}, "weight": 0.3}
    assert [r[0] for r in df.select(target_weight(rule)).collect()] == [0.3, -0.3, 0.0]


def test_top_k_breaks_ties_by_descending_id_and_puts_missing_last(spark):
    rows = [("a", at(0), 1.0), ("b", at(0), 1.0), ("c", at(0), None), ("d", at(0), 0.5)]
    df = spark.createDataFrame(rows, "instrument_id STRING, at TIMESTAMP, s DOUBLE")
    pick = lambda k, **kw: sorted(r.instrument_id for r in targets.top_k(df, k, at="at", rank_by="s", **kw).collect())
    assert pick(1) == ["b"] and pick(3) == ["a", "b", "d"]
    assert pick(1, ascending=True) == ["d"] and pick(3, ascending=True) == ["a", "b", "d"]


def z_rows(spark, values):
    return spark.createDataFrame([("X", at(i), v) for i, v in enumerate(values)], "instrument_id STRING, bar_start TIMESTAMP, z DOUBLE")


def test_hysteresis_by_hand(spark):
    values = [0.0, -2.0, -1.0, None, 0.5, 2.0, 2.5, 0.1, -0.1, -3.0, 3.0, 3.0]
    got = targets.hysteresis(z_rows(spark, values), zscore="z", entry_z=1.5, width=2 * 60 * 10**6)
    assert [r.state for r in got.orderBy("bar_start").collect()] == [0, 1, 1, 1, 0, -1, -1, -1, 0, 1, 0, -1]
    one = targets.hysteresis_long(z_rows(spark, values), zscore="z", entry_z=1.5)
    assert [r.state for r in one.orderBy("bar_start").collect()] == [0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0]


@pytest.mark.parametrize("width", ["2m", "1h", "1d"])
def test_schedule_is_greedy_at_any_split(spark, width):
    minutes = [0, 1, 4, 5, 9, 10, 11, 30, 31, 34, 36, 60, 61, 66, 71]
    df = spark.createDataFrame([(at(m),) for m in minutes], "decision_at TIMESTAMP")
    got = rows_of(targets.scheduled(df, "5m", width=width), "decision_at")
    assert got == [(at(m),) for m in (0, 5, 10, 30, 36, 60, 66, 71)]


def test_schedules_of_many_keys_follow_their_own_clocks(spark):
    rng = random.Random(3)
    clocks = {"hot": sorted(rng.sample(range(20_000), 3000)), "one": [7], "two": [3, 4]}
    rows = [(k, at(m)) for k, ms in clocks.items() for m in ms] + [("hot", None), ("hot", at(clocks["hot"][0]))]
    df = spark.createDataFrame(rows, "k STRING, decision_at TIMESTAMP")
    plan = targets.scheduled(df, "11m", keys=["k"])
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    expected = []
    for k, ms in clocks.items():
        free = None
        for m in ms:
            if free is None or m >= free:
                expected.append((k, at(m)))
                free = m + 11
    assert rows_of(plan, "k", "decision_at") == sorted(expected)


def test_no_instants_no_schedule(spark):
    assert targets.scheduled(spark.createDataFrame([], "decision_at TIMESTAMP"), "5m").count() == 0


def test_initial_allocation_waits_for_every_name(spark, make_bars):
    bars = make_bars([1, 2, 3]).unionByName(make_bars([1, 2, 3], inst="Y", skip=(0,)))
    got = targets.initial_allocation(targets.decision_instants(bars), bars, {"X": 0.5, "Y": 0.25})
    assert rows_of(got.select("decision_at", "instrument_id", "target"), "decision_at", "instrument_id") == [
        (at(1, 2), "X", 0.5), (at(2, 2), "X", 0.5), (at(2, 2), "Y", 0.25)]


ORDER = ("order_id STRING, instrument_id STRING, side STRING, quantity DOUBLE, signal_at TIMESTAMP, "
         "liquidity_estimate DOUBLE, volatility_estimate DOUBLE, increment DOUBLE")


def order(spark, execution, quantity=10.0, signal=None, liquidity=None, increment=1.0):
    row = ("o1", "X", "buy", quantity, signal or at(2), liquidity, None, increment)
    return ex.order_times(spark.createDataFrame([row], ORDER), execution)


def fills_of(spark, bars, execution, **kw):
    made = ex.match_orders(order(spark, execution, **kw), bars, execution, step="1m")
    return rows_of(made.select("fill_at", "reference_price", "quantity"), "fill_at", "fill_no")


NEXT = "next_open_after_eligibility"


def test_next_open_needs_a_later_clock_step(spark, make_bars):
    bars = make_bars([100, 102, 104, 106], opens=[100, 102, 104, 106])
    same = ex.Execution(order_latency=0, expire_after=None, fill_rule=NEXT, participation_cap=None)
    assert fills_of(spark, bars, same) == [(at(3), 106.0, 10.0)], "the open at the signal itself has passed"
    late = ex.Execution(order_latency="1s", expire_after=None, fill_rule=NEXT, participation_cap=None)
    assert fills_of(spark, bars, late, signal=at(1, 2)) == [(at(2), 104.0, 10.0)]


def test_caps_split_orders_and_expiry_is_strict(spark, make_bars):
    bars = make_bars([100] * 9, opens=list(range(100, 109)), skip=(4,))
    cap = ex.Execution(order_latency="1s", expire_after="4m", fill_rule=NEXT, participation_cap=0.1)
    got = fills_of(spark, bars, cap, quantity=25.0, signal=at(1, 2), liquidity=100.0)
    assert got == [(at(2), 102.0, 10.0), (at(3), 103.0, 10.0), (at(5), 105.0, 5.0)]
    got = fills_of(spark, bars, cap, quantity=25.0, signal=at(1), liquidity=100.0)
    assert [g[0] for g in got] == [at(2), at(3)], "an open at expires_at is too late"
    assert fills_of(spark, bars, cap, quantity=25.0, liquidity=5.0) == [], "below one increment nothing fills"
    left = ex.unfilled(order(spark, cap, quantity=25.0, signal=at(1), liquidity=100.0),
                       ex.match_orders(order(spark, cap, quantity=25.0, signal=at(1), liquidity=100.0), bars, cap, step="1m"))
    assert rows_of(left.select("remaining", "status")) == [(5.0, "expired")]


def test_current_bar_rule_and_its_edges(spark, make_bars):
    bars = make_bars([100] * 6, opens=list(range(100, 106)), skip=(3,))
    rule = ex.Execution(order_latency="1s", expire_after="1s", participation_cap=0.1)
    got = fills_of(spark, bars, rule, quantity=5.0, signal=at(1, 2), liquidity=100.0)
    assert got == [(at(1, 3), 101.0, 5.0)], "the immediate fill does not look at expiry"
    wait = ex.Execution(order_latency="1s", expire_after="9m", participation_cap=0.1)
    got = fills_of(spark, bars, wait, quantity=15.0, signal=at(3, 2), liquidity=100.0)
    assert got == [(at(4), 104.0, 10.0), (at(5), 105.0, 5.0)], "no bar holds the instant: all waits"
    exact = ex.Execution(order_latency="58s", expire_after="9m", participation_cap=0.1)
    got = fills_of(spark, bars, exact, quantity=15.0, signal=at(1, 2), liquidity=100.0)
    assert got == [(at(2), 102.0, 10.0), (at(2), 102.0, 5.0)], "one open serves both parts"


def costed(spark, costs, side="buy", quantity=10.0, price=104.0, liquidity=None, vol=None):
    df = spark.createDataFrame([(side, quantity, price, liquidity, vol)],
        "side STRING, quantity DOUBLE, reference_price DOUBLE, liquidity_estimate DOUBLE, volatility_estimate DOUBLE")
    return ex.execution_costs(ex.with_costs_of(df, costs)).first()


def test_costs_by_hand(spark):
    costs = ex.Costs(2.5, 1.0, "fixed_bps", 5.0)
    buy = costed(spark, costs)
    assert (buy.half_spread, buy.slippage, buy.price, buy.fee) == pytest.approx((0.026, 0.052, 104.078, 0.104078))
    assert costed(spark, costs, side="sell", price=106.0).price == pytest.approx(106 - 0.0265 - 0.053)
    flat = ex.Costs(0, 0, "fixed_bps", 0, fee_per_unit=0.005, min_commission=1.0)
    assert costed(spark, flat).fee == 1.0 and costed(spark, flat, quantity=1000.0).fee == pytest.approx(5.0)
    linear = ex.Costs(0, 0, "participation", 25.0, 10.0)
    assert costed(spark, linear, liquidity=100.0).slippage == pytest.approx(104 * 25e-4 * 0.1)
    assert costed(spark, linear).slippage == pytest.approx(0.104), "no estimate: fallback"
    root = ex.Costs(0, 0, "sqrt_impact", 0.5, 10.0)
    assert costed(spark, root, liquidity=1000.0, vol=0.02).slippage == pytest.approx(104 * 0.5 * 0.02 * 0.1)
    assert costed(spark, root, liquidity=1000.0).slippage == pytest.approx(0.104)
    assert len(ex.SCENARIOS) == 8


def size(spark, intents, *, positions=None, pending=None, equity=100_000.0, cash=100_000.0, marks=None, increments=None, **limits):
    marks = {"X": 100.0, "Y": 50.0, "Z": 10.0} if marks is None else marks
    increments = increments or {"X": 1.0, "Y": 1.0, "Z": 1.0}
    rows = [(at(0), at(i[3]) if len(i) > 3 else at(0), i[1], i[0], float(i[2])) for i in intents]
    asked = spark.createDataFrame(rows, "decision_at TIMESTAMP, created_at TIMESTAMP, instrument_id STRING, kind STRING, value DOUBLE")
    state = spark.createDataFrame([(at(0), equity, cash)], "decision_at TIMESTAMP, equity DOUBLE, cash DOUBLE")
    held = spark.createDataFrame(
        [(at(0), k, marks.get(k), float((positions or {}).get(k, 0)), float((pending or {}).get(k, 0)), v) for k, v in increments.items()],
        "decision_at TIMESTAMP, instrument_id STRING, mark DOUBLE, position DOUBLE, pending DOUBLE, increment DOUBLE")
    out = size_targets(asked, state, held, Limits(**limits)).collect()
    by = {(r.instrument_id, r.kind): (r.final_quantity, r.rejection) for r in out}
    return [by[i[1], i[0]] for i in intents]


@pytest.mark.parametrize("intents, state, expected", [
    ([("target_weight", "X", 0.5)], {}, [(500.0, None)]),
    ([("target_quantity", "X", 175)], {"positions": {"X": 100}, "pending": {"X": 50}}, [(25.0, None)]),
    ([("target_quantity", "X", 150)], {"positions": {"X": 100}, "pending": {"X": 50}}, [(0.0, None)]),
    ([("delta", "X", 55)], {"increments": {"X": 10.0}}, [(50.0, None)]),
    ([("delta", "X", 5)], {"increments": {"X": 10.0}}, [(0.0, "below_increment")]),
    ([("delta", "X", -10)], {}, [(0.0, "short_not_allowed")]),
    ([("delta", "X", -10)], {"positions": {"X": 6}}, [(-6.0, None)]),
    ([("delta", "X", -10)], {"allow_short": True}, [(-10.0, None)]),
    ([("target_weight", "X", 0.5)], {"max_weight": 0.3}, [(300.0, None)]),
    ([("delta", "X", -100)], {"positions": {"X": 900}, "cash": 10_000.0, "max_weight": 0.3}, [(-100.0, None)]),
    ([("target_weight", "X", 0.7), ("target_weight", "Y", 0.7)], {"cost_buffer_bps": 0.0}, [(500.0, None), (1000.0, None)]),
    ([("target_weight", "X", 0.8)], {"positions": {"Z": 5000}, "cash": 50_000.0, "cost_buffer_bps": 0.0}, [(500.0, None)]),
    ([("target_weight", "X", 0.5)], {"positions": {"Z": 5000}, "cash": 50_000.0}, [(499.0, None)]),
    ([("target_weight", "Y", 0.0), ("target_weight", "X", 0.9)], {"positions": {"Y": 2000}, "cash": 0.0, "cost_buffer_bps": 0.0}, [(-2000.0, None), (900.0, None)]),
    ([("delta", "X", 1, 4)], {}, [(0.0, "stale_intent")]),
    ([("delta", "Q", 1)], {}, [(0.0, "unknown_instrument")]),
    ([("target_weight", "X", 0.5)], {"marks": {}}, [(0.0, "no_mark")]),
    ([("delta", "X", 5)], {"marks": {}}, [(5.0, None)]),
    ([("target_weight", "X", 0.7), ("target_weight", "Y", 0.7)], {}, [(499.0, None), (999.0, None)]),
])
def test_sizing(spark, intents, state, expected):
    assert size(spark, intents, **state) == expected


FILL = ("n INT, instrument_id STRING, side STRING, quantity DOUBLE, fill_at TIMESTAMP, reference_price DOUBLE, "
        "half_spread DOUBLE, slippage DOUBLE, price DOUBLE, fee DOUBLE")


def fills(spark, *rows):
    """(minute, instrument, side, quantity, price, half spread, fee)"""
    made = [(n, i, s, float(q), at(m), float(p), float(h), 0.0, float(p) + (h if s == "buy" else -h), float(f))
            for n, (m, i, s, q, p, h, f) in enumerate(rows)]
    return spark.createDataFrame(made, FILL)


ORD = ["fill_at", "n"]


def trades_of(spark, *rows, **kw):
    return ledger.trades(fills(spark, *rows), order=ORD, **kw).orderBy("instrument_id", "trade_no").collect()


def test_round_trips_adds_and_shorts(spark):
    t = trades_of(spark, (0, "X", "buy", 10, 100, 0, 0), (1, "X", "buy", 10, 102, 0, 0), (2, "X", "sell", 5, 108, 0, 0),
                  (3, "X", "sell", 15, 110, 0, 0), (0, "Y", "sell", 10, 100, 0, 0), (5, "Y", "buy", 10, 90, 0, 0))
    assert [(r.direction, r.fill_count, r.peak_quantity, r.net_pnl, r.entry_price) for r in t] == [
        ("long", 4, 20.0, 170.0, 101.0), ("short", 2, 10.0, 100.0, 100.0)]
    assert t[0].duration_s == 180.0 and not t[0].is_open


def test_a_flip_is_two_trades_that_share_the_fee(spark):
    t = trades_of(spark, (0, "X", "buy", 10, 100, 0, 0), (5, "X", "sell", 20, 110, 0, 6), (9, "X", "buy", 10, 110, 0, 0))
    assert [(r.direction, r.costs, r.gross_pnl) for r in t] == [("long", 3.0, 100.0), ("short", 3.0, 0.0)]
    assert t[0].closed_at == t[1].opened_at


def test_bucket_width_does_not_change_ledgers(spark):
    rows = [(i % 50 + i // 50, "HOT" if i % 3 else "C", "buy" if i * 7 % 5 < 2 else "sell", i % 4 + 1, 90 + i % 21, 0.1, 0.2)
            for i in range(120)]
    f = fills(spark, *rows)
    cols = ["instrument_id", "trade_no", "direction", "fill_count", "net_pnl", "is_open"]
    calm, split = (ledger.trades(f, order=ORD, width=w).select(*cols) for w in (30 * DAY, 5 * MINUTE))
    assert [str(r) for r in calm.orderBy(*cols[:2]).collect()] == [str(r) for r in split.orderBy(*cols[:2]).collect()]
    a, b = (ledger.average_cost(f, order=ORD, width=w).orderBy("n").collect() for w in (30 * DAY, 5 * MINUTE))
    assert [r.avg_cost for r in a] == pytest.approx([r.avg_cost for r in b])
    assert sum(r.realized_pnl for r in a) == pytest.approx(sum(r.realized_pnl for r in b))


def test_open_trades_are_valued_or_unknown(spark):
    rows = [(0, "X", "buy", 10, 100, 0.05, 1)]
    (unknown,) = trades_of(spark, *rows)
    assert unknown.is_open and unknown.net_pnl is None and unknown.exit_price is None and unknown.costs == 1.5
    marks = spark.createDataFrame([("X", 120.0)], "instrument_id STRING, price DOUBLE")
    (marked,) = trades_of(spark, *rows, marks=marks)
    assert marked.gross_pnl == 200.0 and marked.net_pnl == 198.5 and marked.exit_price == 120.0


def test_trade_statistics(spark):
    t = ledger.trades(fills(spark, (0, "X", "buy", 1, 100, 0, 0), (1, "X", "sell", 1, 110, 0, 0), (2, "X", "buy", 1, 100, 0, 0),
                            (5, "X", "sell", 1, 96, 0, 0), (6, "X", "buy", 1, 1, 0, 0)), order=ORD)
    s = metrics.trade_statistics(t).first()
    assert (s.trade_count, s.open_at_end, s.win_rate, s.profit_factor, s.expectancy, s.median_duration_s) == (2, 1, 0.5, 2.5, 3.0, 120.0)
    only_wins = metrics.trade_statistics(t.where("net_pnl > 0")).first()
    assert only_wins.profit_factor is None


def test_average_cost_and_curve_reconcile(spark):
    f = fills(spark, (0, "X", "buy", 10, 100, 0, 1), (1, "X", "buy", 10, 110, 0, 1), (2, "X", "sell", 5, 120, 0, 1),
              (3, "X", "sell", 25, 90, 0, 1), (5, "X", "buy", 10, 80, 0, 1), (1, "Y", "buy", 2, 50, 0, 0))
    costed = ledger.average_cost(f, order=ORD, width=2 * 60 * 10**6)
    got = rows_of(costed.where("instrument_id = 'X'").select("position", "avg_cost", "realized_pnl"), "fill_at")
    assert got == [(10.0, 100.0, 0.0), (20.0, 105.0, 0.0), (15.0, 105.0, 75.0), (-10.0, 90.0, -225.0), (0.0, 0.0, 100.0)]
    marks = spark.createDataFrame([("X", at(4), 85.0), ("Y", at(4), 60.0), ("W", at(7), 1.0)], "instrument_id STRING, at TIMESTAMP, price DOUBLE")
    curve = ledger.equity_curve(f, marks, initial_cash=10_000.0, fill_order=ORD)
    by = {r.at.astimezone(UTC): r for r in curve.collect()}
    assert by[at(0)].equity == 9_999.0, "valued at the first fill until a mark exists"
    assert by[at(4)].net_exposure == -850.0 + 120.0 and by[at(4)].gross_exposure == 970.0
    assert by[at(5)].position_count == 1 and by[at(7)].equity == by[at(5)].equity
    assert by[at(5)].equity == pytest.approx(10_000 + 75 - 225 + 100 + 20 - 5)
    full = ledger.equity_curve(f, marks, initial_cash=10_000.0, fill_order=ORD, pnl=True)
    by = {r.at.astimezone(UTC): r for r in full.collect()}
    assert [by[at(m)].realized_pnl for m in (0, 1, 2, 3, 4, 5)] == pytest.approx([0, 0, 75, -150, -150, -50])
    # X is short 10 at 90 and marked 85; Y holds 2 at 50, marked 60.
    assert by[at(4)].unrealized_pnl == pytest.approx(50 + 20) and by[at(5)].unrealized_pnl == pytest.approx(20)
    assert ledger.reconcile(full, initial_cash=10_000.0).count() == 0
    spoiled = full.withColumn("equity", F.col("equity") + F.when(F.col("at") == F.lit(at(3)), 1).otherwise(0))
    assert ledger.reconcile(spoiled, initial_cash=10_000.0).count() == 1


STALE = "instrument_id STRING, at TIMESTAMP"


def test_a_position_stale_between_fills_gives_one_row(spark):
    """X publishes until 3:02 and is held from minute 2 on; every publication of Y values the book."""
    f = fills(spark, (2, "X", "buy", 10, 104, 0, 0))
    held = ledger.positions(f, order=ORD)
    marks = spark.createDataFrame([("X", at(m, 2)) for m in (1, 2, 3)] + [("Y", at(m, 2)) for m in range(1, 13)], STALE)
    clock = marks.select("at").distinct()
    got = ledger.stale_spans(held, marks, clock, limit="5m", order=ORD).collect()
    assert [(r.instrument_id, r.first_at.astimezone(UTC), r.occurrences, r.stale_to) for r in got] == [("X", at(9, 2), 4, None)]


def test_stale_spans_end_with_a_mark_or_a_flat_position(spark):
    rng = random.Random(8)
    moves, marks, rows = {}, {}, []
    for name in "ABC":
        marks[name] = sorted(rng.sample(range(200), 12))
        for m in sorted(rng.sample(range(200), 25)):
            side, qty = rng.choice([("buy", 1), ("sell", 1), ("buy", 2)])
            moves.setdefault(name, []).append((m, qty if side == "buy" else -qty))
            rows.append((m, name, side, qty, 100, 0, 0))
    held = ledger.positions(fills(spark, *rows), order=ORD)
    clock = sorted({m for ms in marks.values() for m in ms} | {r[0] for r in rows} | set(range(0, 200, 3)))
    expected = []
    for name in "ABC":
        last, open_row = None, None
        for t in clock:
            position = sum(q for m, q in moves[name] if m <= t)
            mark = max((m for m in marks[name] if m <= t), default=None)
            stale = position != 0 and mark is not None and t - mark > 7
            # A span ends between two instants of the clock only with a mark or a flat position.
            if stale and open_row is not None and last == mark:
                open_row[3] += 1
            elif stale:
                open_row = [name, at(mark), at(t), 1]
                expected.append(open_row)
            if not stale:
                open_row = None
            last = mark
    frame = spark.createDataFrame([(n, at(m)) for n, ms in marks.items() for m in ms], STALE)
    got = ledger.stale_spans(
        held, frame, spark.createDataFrame([(at(t),) for t in clock], "at TIMESTAMP"), limit="7m", order=ORD, width=40 * 60 * 10**6
    )
    assert rows_of(got.select("instrument_id", "mark_at", "first_at", "occurrences"), "instrument_id", "first_at") == sorted(map(tuple, expected))


def test_names_that_leave_the_set_are_closed(spark):
    rows = [("A", 0, 0.5), ("A", 1, 0.5), ("A", 2, 0.3), ("B", 1, 0.2), ("B", 2, 0.0), ("A", 5, 0.3), ("C", 3, None), ("C", 4, 0.1)]
    table = spark.createDataFrame([(n, at(m), t) for n, m, t in rows], "instrument_id STRING, decision_at TIMESTAMP, target DOUBLE")
    clock = spark.createDataFrame([(at(m),) for m in range(6)], "decision_at TIMESTAMP")
    got = rows_of(targets.rule_changes(table, clock, width=2 * 60 * 10**6), "decision_at", "instrument_id")
    assert got == [
        ("A", at(0), 0.5, 0.0), ("B", at(1), 0.2, 0.0), ("A", at(2), 0.3, 0.5), ("B", at(2), 0.0, 0.2),
        ("A", at(3), 0.0, 0.3), ("C", at(4), 0.1, 0.0), ("A", at(5), 0.3, 0.0), ("C", at(5), 0.0, 0.1),
    ]


def curve_of(spark, values, key="r"):
    rows = [(key, at(i), float(v), float(v) / 2, float(v) / 4) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k STRING, at TIMESTAMP, equity DOUBLE, gross_exposure DOUBLE, net_exposure DOUBLE")


def test_metrics_by_hand(spark):
    ann = metrics.annualization_for("24x7:1", "1m")
    assert ann.periods_per_year == 525_960 and metrics.annualization_for("XNYS:1", "5m").periods_per_year == 19_656
    with pytest.raises(KeyError):
        metrics.annualization_for("LSE:1", "1m")
    m = metrics.performance(curve_of(spark, [100, 110, 99, 110, 104]), keys=["k"], bar_size="1m", annualization=ann).first()
    assert m.periods == 4 and m.total_return == pytest.approx(0.04) and m.max_drawdown == pytest.approx(0.1)
    assert m.max_drawdown_us == 60_000_000, "equal equity moves the peak"
    assert m.period_hit_rate == 0.5 and m.avg_gross_exposure == 0.5 and m.fill_count == 0
    one = metrics.performance(curve_of(spark, [100]), keys=["k"], bar_size="1m", annualization=ann).first()
    assert one.periods == 0 and one.sharpe is None and one.annualized_return is None


def test_stitching_chains_folds(spark):
    rows = [("t", f, at(m), float(e)) for f, m, e in [(0, 0, 100), (0, 1, 120), (1, 5, 100), (1, 6, 90)]]
    df = spark.createDataFrame(rows, "role STRING, fold INT, at TIMESTAMP, equity DOUBLE")
    assert [r.equity for r in metrics.stitch(df).orderBy("at").collect()] == pytest.approx([100, 120, 120, 108])


def test_histogram_and_downsample(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 31, 30.9)], "v DOUBLE")
    got = rows_of(metrics.histogram(df, "v").select("bin", "n"), "bin")
    assert len(got) == 31 and [r for r in got if r[1]] == [(0, 2), (30, 2)]
    one = spark.createDataFrame([(5.0,)], "v DOUBLE")
    assert metrics.histogram(one, "v").where("n > 0").first().bin_low == pytest.approx(4 + 15 * 2 / 31)
    series = spark.createDataFrame([(at(i), float((i * 37) % 101)) for i in range(101)], "at TIMESTAMP, v DOUBLE")
    few = metrics.downsample(series, at="at", value="v", limit=10)
    kept = [r.v for r in few.collect()]
    assert max(kept) == 100 and min(kept) == 0 and len(kept) <= 12
    assert metrics.downsample(series, at="at", value="v", limit=101).count() == 101


def test_agreement_and_grid(spark):
    a = spark.createDataFrame([("r", 1.0, 1.0, None, 1.0, None)], "k STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE")
    b = spark.createDataFrame([("r", 1.0, 1.0 + 1e-12, 2.0, 2.0, None)], a.schema)
    got = runs.agreement(a, b, on=["k"], columns=list("abcde"))
    assert {r.metric: r.agreement for r in got.collect()} == {
        "a": "exact", "b": "within_tolerance", "c": "missing", "d": "different", "e": "exact"}
    axes = [
        [F.struct(F.lit(x).alias("x")) for x in (1, 2)],
        [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in ((1, 2), (3, 4))],
    ]
    points = runs.with_grid(a.select("k"), axes).collect()
    assert sorted((r.trial, r.x, r.p, r.q) for r in points) == [(0, 1, 1, 2), (1, 1, 3, 4), (2, 2, 1, 2), (3, 2, 3, 4)]


@pytest.mark.parametrize("limit", [3, 10**9])
def test_large_and_short_keys_give_the_same_ledgers(spark, monkeypatch, limit):
    """Some keys split, and none, against all."""
    rows = [(m, i, "buy" if (m * 7 + len(i)) % 3 else "sell", 1 + m % 4, 10 + m % 5, 0.1, 0.2)
            for i, n in (("X", 40), ("YY", 3), ("ZZZ", 2)) for m in range(n)]
    f = fills(spark, *rows)
    marks = spark.createDataFrame([(i, at(m), 9.0 + m) for i in ("X", "YY") for m in (0, 9, 25)],
                                  "instrument_id STRING, at TIMESTAMP, price DOUBLE")

    def ledgers():
        held = ledger.positions(f, order=ORD, width=MINUTE)
        made = [
            held, ledger.average_cost(f, order=ORD, width=MINUTE), ledger.trades(f, order=ORD, width=MINUTE),
            ledger.stale_marks(held, marks, at="fill_at", limit="2m"),
            ledger.stale_spans(held, marks, f.select(F.col("fill_at").alias("at")), limit="2m", order=ORD, width=MINUTE),
        ]
        out = []
        for df in made:
            digits = {c: F.round(c, 9) for c, t in df.dtypes if t == "double"}
            out.append(sorted(map(str, df.withColumns(digits).collect())))
        return out

    monkeypatch.setattr(ordered, "LARGE_KEY", limit)
    some = ledgers()
    monkeypatch.setattr(ordered, "LARGE_KEY", -1)
    assert all(some) and some == ledgers()


def test_short_keys_are_shuffled_once(spark):
    """One exchange for the fills of short keys, however many scans follow."""
    rows = [(m, "X", "buy" if m % 2 else "sell", 1, 10, 0.1, 0.2) for m in range(6)]
    made = ledger._trades(fills(spark, *rows), ["instrument_id"], ORD, None, None)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
