"""What happens to orders and positions when an account's decision range ends.

Two policies. ``mark`` lets orders go on filling while there is data, cancels what is still
pending at the last instant, and values open positions at the last mark. ``liquidate`` acts at
the first instant at or after the end of the range: fills of that instant still count, pending
orders are cancelled, and every position that is not flat gets a flattening order, which then
waits for opens like any other. Where there is no such instant, or no open before the order
expires, the position stays and the account has a finding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import shift
from pitbars.operators import execution as ex
from pitbars.operators.joins import nearest
from pitbars.operators.ledger import signed_quantity, snapped
from pitbars.session import staged

POLICIES = ("mark", "liquidate")
_EVENT = ["order_id", "instrument_id", "remaining", "at", "status"]


def instants_of(bars: DataFrame) -> DataFrame:
    """Every instant ``at`` at which a bar opens or is published."""
    opens, published = (bars.select(F.col(c).alias("at")) for c in ("bar_start", "available_at"))
    return opens.unionByName(published).distinct()


def range_ends(spans: DataFrame, instants: DataFrame) -> DataFrame:
    """``spans`` with ``ends_at``, the first instant at or after their ``end``, or null."""
    found = nearest(
        spans.withColumn("__one", F.lit(1)), instants.withColumn("__one", F.lit(1)),
        left_on=F.col("end"), right_on=F.col("at"), by=["__one"], tiebreak=[], forward=True, name="__next",
    )
    return found.select(*spans.columns, F.col("__next.at").alias("ends_at"))


def _remaining(orders: DataFrame, fills: DataFrame) -> DataFrame:
    done = fills.groupBy("order_id").agg(F.sum("quantity").alias("__filled"))
    left = F.col("quantity") - F.coalesce("__filled", F.lit(0.0))
    joined = orders.join(done, "order_id", "left").withColumn("remaining", left).drop("__filled")
    return joined.where(F.col("remaining") > ex.TOLERANCE)


def open_positions(fills: DataFrame, account: Sequence[str]) -> DataFrame:
    """``account, instrument_id, position`` of what is not flat after all fills."""
    held = fills.groupBy(*account, "instrument_id").agg(snapped(F.sum(signed_quantity())).alias("position"))
    return held.where("position <> 0")


def close_accounts(
    orders: DataFrame, fills: DataFrame, bars: DataFrame, spans: DataFrame, execution: ex.Execution, *,
    policy: str, step: str | int, account: Sequence[str], span: Sequence[str] = ("fold", "role"),
    increment: float = 1e-6,
) -> dict[str, DataFrame]:
    """Fills under an end-of-range policy, and what the end did.

    ``orders`` and ``fills`` (before costs) carry the ``account`` columns, ``span`` among them;
    ``spans`` holds ``span, end``. Returns ``fills`` with ``liquidation`` saying which flatten a
    position, ``events`` (cancelled or expired remainders with their instant), ``findings``
    (``code, account, instrument_id, at``) and ``positions`` that are still open with the last
    ``mark`` and their ``value``.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown end-of-range policy {policy!r}; known: {POLICIES}")
    account, span = list(account), list(span)
    instants = staged(instants_of(bars), "instants")
    last = instants.agg(F.max("at")).scalar()
    marked = bars.groupBy("instrument_id").agg(
        F.max_by("close", F.struct("available_at", "bar_start", "revision")).alias("mark")
    )
    if policy == "mark":
        ends = spans.select(*span, "end").withColumn("ends_at", last)
        after = F.lit(False)
    else:
        ends = range_ends(spans.select(*span, "end"), instants)
        after = F.coalesce(F.col("fill_at") > F.col("ends_at"), F.lit(False))
    ends = staged(ends, "range-ends")
    kept = staged(fills.join(ends, span).where(~after).drop("end", "ends_at").withColumn("liquidation", F.lit(False)), "kept")
    left = _remaining(orders.join(ends, span), kept)
    pending = F.col("expires_at").isNull() | (F.col("expires_at") > F.col("ends_at"))
    pending = pending & F.col("ends_at").isNotNull()
    events = left.select(
        *account, "order_id", "instrument_id", "remaining",
        F.when(pending, F.col("ends_at")).otherwise(F.col("expires_at")).alias("at"),
        F.when(pending, "cancelled").otherwise("expired").alias("status"),
    )
    none = open_positions(kept, account).join(ends, span).where("ends_at is null")
    findings = none.select(
        F.lit("liquidation_impossible").alias("code"), *account, "instrument_id", F.col("end").alias("at")
    )
    if policy == "liquidate":
        closing = _flattening(open_positions(kept, account).join(ends, span).where("ends_at is not null"), bars, execution, account, increment)
        closing = staged(closing, "liquidation-orders")
        flat = ex.match_orders(closing, bars, execution, step=step).withColumn("liquidation", F.lit(True))
        flat = staged(flat, "liquidation-fills")
        missed = _remaining(closing, flat)
        events = events.unionByName(missed.select(
            *account, "order_id", "instrument_id", "remaining", F.coalesce("expires_at", last).alias("at"),
            F.when(F.col("expires_at").isNull(), "cancelled").otherwise("expired").alias("status"),
        ))
        findings = findings.unionByName(missed.select(
            F.lit("liquidation_unfilled").alias("code"), *account, "instrument_id", F.col("signal_at").alias("at")
        ))
        kept = kept.unionByName(flat.select(*[c for c in kept.columns if c in flat.columns]), allowMissingColumns=True)
    open_now = open_positions(kept, account).join(marked, "instrument_id", "left")
    positions = open_now.withColumn("value", F.col("position") * F.col("mark"))
    return {"fills": kept, "events": events, "findings": findings, "positions": positions}


def _flattening(
    held: DataFrame, bars: DataFrame, execution: ex.Execution, account: Sequence[str], increment: float
) -> DataFrame:
    """Orders at ``ends_at`` that bring every held position to zero."""
    name = [F.col(c).cast("string") for c in account]
    orders = held.select(
        *account, "instrument_id", F.col("ends_at").alias("signal_at"),
        F.when(F.col("position") > 0, "sell").otherwise("buy").alias("side"),
        F.abs("position").alias("quantity"), F.lit(increment).alias("increment"),
        F.concat_ws("|", *name, "instrument_id", F.lit("liquidation")).alias("order_id"),
    )
    estimates = ex.liquidity_estimates(bars, execution.liquidity_lookback)
    return ex.order_times(ex.attach_estimates(orders, estimates), execution)
