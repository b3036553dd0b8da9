"""What the end of a decision range does to orders and positions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from instants import at, rows_of
from pitbars.operators import execution as ex
from pitbars.operators import rangeend
from pitbars.operators.ledger import signed_quantity

UTC = dt.timezone.utc
HOW = ex.Execution(order_latency="1s", expire_after=None, fill_rule="next_open_after_eligibility", participation_cap=None)
# Minute, open, close.
SIX = [(0, 100.0, 101.0), (1, 102.0, 103.0), (2, 104.0, 105.0), (3, 106.0, 107.0), (4, 108.0, 109.0), (5, 110.0, 111.0)]
GAP = SIX[:4] + [(10, 120.0, 121.0)]


@pytest.fixture
def run(spark, make_bars):
    """Buy 10 at the publication of the given bars, with the range ending at a minute."""

    def go(table, decided, end, policy="liquidate", how=HOW):
        size = table[-1][0] + 1
        known = {m: (o, c) for m, o, c in table}
        opens = [known.get(m, (1.0, 1.0))[0] for m in range(size)]
        bars = make_bars([known.get(m, (1.0, 1.0))[1] for m in range(size)], opens=opens, skip=[m for m in range(size) if m not in known])
        rows = [(0, "test", f"o{m}", "X", at(m + 1, 2), "buy", 10.0, 1e-6) for m in decided]
        orders = spark.createDataFrame(rows, "fold INT, role STRING, order_id STRING, instrument_id STRING, signal_at TIMESTAMP, side STRING, quantity DOUBLE, increment DOUBLE")
        nothing = F.lit(None).cast("double")
        orders = ex.order_times(orders.withColumns({"liquidity_estimate": nothing, "volatility_estimate": nothing}), how)
        spans = spark.createDataFrame([(0, "test", at(end))], "fold INT, role STRING, end TIMESTAMP")
        fills = ex.match_orders(orders, bars, how, step="1m")
        return rangeend.close_accounts(orders, fills, bars, spans, how, policy=policy, step="1m", account=["fold", "role"])

    return go


def test_positions_are_flattened_at_the_first_open_after_the_range(run):
    made = run(SIX, [1], 3)
    assert rows_of(made["fills"].select("fill_at", "reference_price", "side", "liquidation"), "fill_at") == [
        (at(3), 106.0, "buy", False), (at(4), 108.0, "sell", True)]
    assert made["positions"].count() == made["findings"].count() == made["events"].count() == 0


def test_an_order_that_fills_at_the_end_instant_counts(run):
    made = run(SIX, [0, 2], 4)
    assert rows_of(made["fills"].select("fill_at", "quantity", "liquidation"), "fill_at") == [
        (at(2), 10.0, False), (at(4), 10.0, False), (at(5), 20.0, True)]
    assert made["events"].count() == 0


def test_pending_orders_are_cancelled_and_only_open_positions_flattened(run):
    made = run(GAP, [0, 3], 4)
    assert rows_of(made["events"].select("order_id", "at", "status", "remaining")) == [("o3", at(4, 2), "cancelled", 10.0)]
    assert rows_of(made["fills"].select("fill_at", "reference_price", "liquidation"), "fill_at")[-1] == (at(10), 120.0, True)
    assert made["fills"].agg(F.sum(signed_quantity())).first()[0] == 0.0


def test_no_instant_after_the_range_is_a_finding(run):
    made = run(SIX, [0], 100)
    assert [(r.code, r.instrument_id) for r in made["findings"].collect()] == [("liquidation_impossible", "X")]
    assert [(r.position, r.value) for r in made["positions"].collect()] == [(10.0, 1110.0)]


def test_no_open_before_expiry_is_a_finding(run):
    short = ex.Execution(order_latency="1s", expire_after="2m", fill_rule="next_open_after_eligibility", participation_cap=None)
    made = run(GAP, [0], 4, how=short)
    assert [(r.code, r.instrument_id) for r in made["findings"].collect()] == [("liquidation_unfilled", "X")]
    assert made["positions"].first().position == 10.0


def test_marking_leaves_positions_at_the_last_close(run):
    made = run(SIX, [0, 5], 3, policy="mark")
    assert [(r.position, r.mark) for r in made["positions"].collect()] == [(10.0, 111.0)]
    assert rows_of(made["events"].select("order_id", "status", "at")) == [("o5", "cancelled", at(6, 2))]
    with pytest.raises(ValueError, match="unknown end-of-range"):
        run(SIX, [1], 3, policy="forget")
