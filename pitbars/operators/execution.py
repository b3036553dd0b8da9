"""Orders to fills, and the cost columns of a fill.

An order's fills are found by position: one ordered scan over opens and order instants
gives the positions of the first eligible open and of the first open at or after expiry,
the number of fills follows from quantity and cap, and the fills join the opens on
``(instrument, position)``. The join output is exactly the fills;
no order meets opens it does not trade at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import floor_to_increment, instant, shift, time_bucket
from pitbars.operators.joins import nearest
from pitbars.operators.ordered import CHUNK_ROWS, rolling, running
from pitbars.types import DAY, micros

FILL_RULES = ("open_of_current_bar", "next_open_after_eligibility")
TOLERANCE = 1e-12


@dataclass(frozen=True)
class Costs:
    """Cost assumptions; all are columns of the scenario table as well."""

    half_spread_bps: float = 2.5
    commission_bps: float = 1.0
    slippage: str = "participation"
    coefficient: float = 25.0
    fallback_bps: float = 10.0
    fee_per_unit: float = 0.0
    min_commission: float = 0.0


# The named cost scenarios.
SCENARIOS = {
    "base": Costs(),
    "free": Costs(0.0, 0.0, "fixed_bps", 0.0, 0.0),
    "low": Costs(1.0, 0.5, "participation", 10.0),
    "measured_retail": Costs(0.72, 10.0, "participation", 25.0),
    "measured_vip": Costs(0.72, 2.0, "participation", 25.0),
    "measured_maker": Costs(0.72, 0.0, "participation", 25.0),
    "measured_perp": Costs(0.43, 5.0, "participation", 25.0),
    "stressed": Costs(10.0, 3.0, "participation", 100.0),
}


@dataclass(frozen=True)
class Execution:
    submission_latency: str | int = 0
    order_latency: str | int = "1s"
    expire_after: str | int | None = "5m"
    fill_rule: str = "open_of_current_bar"
    participation_cap: float | None = 0.1
    liquidity_lookback: int = 20

    def __post_init__(self) -> None:
        if self.fill_rule not in FILL_RULES:
            raise ValueError(f"unknown fill rule {self.fill_rule!r}; known: {FILL_RULES}")
        if self.expire_after is not None and micros(self.expire_after) <= 0:
            raise ValueError("expire_after must be positive or None")


def order_times(signals: DataFrame, execution: Execution, *, at: str = "signal_at") -> DataFrame:
    """Add ``order_at``, ``eligible_at`` and ``expires_at`` to signals."""
    order_at = shift(at, execution.submission_latency)
    expires = (
        F.lit(None).cast("timestamp")
        if execution.expire_after is None
        else shift(order_at, execution.expire_after)
    )
    return signals.withColumns(
        {
            "order_at": order_at,
            "eligible_at": shift(order_at, execution.order_latency),
            "expires_at": expires,
        }
    )


def liquidity_estimates(
    bars: DataFrame, lookback: int = 20, *, keys: Sequence[str] = ("instrument_id",)
) -> DataFrame:
    """Trailing mean volume and return deviation over the last ``lookback`` published bars.

    Rows follow publication order. Both are null until enough bars are out; zero volume
    gives no liquidity, and fewer than two returns give no volatility.
    """

    def returns(w):
        previous = F.lag("close", 1).over(w)
        return {"__r": F.when(previous > 0, F.col("close") / previous - 1)}

    def build(w):
        frame = w.rowsBetween(1 - lookback, 0)
        inner = w.rowsBetween(2 - lookback, 0) if lookback > 1 else w.rowsBetween(0, 0)
        full = F.count("volume").over(frame) == lookback
        mean = F.avg("volume").over(frame)
        enough = F.count("__r").over(inner) >= 2
        return {
            "liquidity_estimate": F.when(full & (mean > 0), mean),
            "volatility_estimate": F.when(
                full & enough & F.lit(lookback > 2), F.stddev_samp("__r").over(inner)
            ),
        }

    slim = bars.select(*keys, "available_at", "bar_start", "volume", "close")
    out = rolling(
        slim,
        keys,
        ["available_at", "bar_start"],
        time_bucket("available_at", 30 * DAY),
        max(lookback - 1, 1),
        build,
        first=[returns],
    )
    return out.select(*keys, "available_at", "bar_start", "liquidity_estimate", "volatility_estimate")


def attach_estimates(orders: DataFrame, estimates: DataFrame, *, at: str = "signal_at") -> DataFrame:
    """Estimates of the latest bar published by the signal instant."""
    found = nearest(
        orders,
        estimates,
        left_on=F.col(at),
        right_on=F.col("available_at"),
        by=["instrument_id"],
        tiebreak=["bar_start"],
        name="__e",
    )
    return found.select(
        *orders.columns, "__e.liquidity_estimate", "__e.volatility_estimate"
    )


def fill_cap(cap: float | None, increment: Column) -> Column:
    """Largest quantity one open may fill; null means no cap applies."""
    if cap is None:
        return F.lit(None).cast("double")
    estimate = F.col("liquidity_estimate")
    return F.when(
        estimate.isNotNull(), floor_to_increment(F.lit(cap) * estimate, increment, TOLERANCE)
    )


def match_orders(
    orders: DataFrame,
    bars: DataFrame,
    execution: Execution,
    *,
    step: str | int,
    increment: str = "increment",
) -> DataFrame:
    """Fills of each order: ``order columns, fill_no, fill_at, reference_price, quantity``.

    ``orders`` carry ``order_id, instrument_id, side, quantity, signal_at, order_at,
    eligible_at, expires_at, liquidity_estimate`` and an increment column. Under the
    current-bar rule the first fill takes the open of the bar that holds ``eligible_at``,
    is dated ``eligible_at``, and is not subject to expiry; what remains (or the whole order
    when no bar holds that instant) waits for later opens like under the other rule.
    """
    width = micros(step) * CHUNK_ROWS
    work = orders.withColumn("__cap", fill_cap(execution.participation_cap, F.col(increment)))
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    # The first open an order may trade at comes after the signal's own clock step.
    earliest = F.greatest(F.col("eligible_at"), shift("signal_at", 1))
    until = F.coalesce("expires_at", never)
    # Opens and the order's instants in one ordered scan: an instant that sorts before the
    # opens at its own time learns how many opens lie strictly before it, which is the
    # position of the first open at or after it.
    probe = lambda name, at, side: F.struct(
        F.lit(name).alias("probe"), at.alias("at"), F.lit(side).alias("side")
    )
    probes = work.select(
        "instrument_id", "order_id",
        F.inline(
            F.array(
                probe("first", earliest, 0), probe("stop", until, 0),
                probe("held", F.col("eligible_at"), 2),
            )
        ),
    )
    stacked = probes.unionByName(
        bars.select(
            "instrument_id", F.col("bar_start").alias("at"), F.lit(1).alias("side"), "open"
        ),
        allowMissingColumns=True,
    )
    is_open = F.col("side") == 1
    scanned = running(
        stacked, ["instrument_id"], ["at", "side", "order_id", "probe"], time_bucket("at", width),
        sums={"count": is_open.cast("bigint")},
        lasts={"bar": F.when(is_open, F.struct(F.col("at").alias("start"), "open"))},
    )
    inside = (F.col("probe") == "held") & (
        F.unix_micros("at") - F.unix_micros("bar.start") < micros(step)
    )
    places = scanned.where(~is_open).groupBy("order_id").agg(
        F.max(F.when(F.col("probe") == "first", F.col("count"))).alias("__first"),
        F.max(F.when(F.col("probe") == "stop", F.col("count"))).alias("__stop"),
        F.max(F.when(inside, F.col("bar.open"))).alias("__now_price"),
    )
    work = work.join(places, "order_id")
    immediate = execution.fill_rule == "open_of_current_bar"
    at_once = F.coalesce(F.least("__cap", "quantity"), F.col("quantity"))
    taken = F.when(F.lit(immediate) & F.col("__now_price").isNotNull(), at_once).otherwise(0.0)
    work = work.withColumn("__now", taken).withColumn("__qty", F.col("quantity") - F.col("__now"))
    slices = (
        F.when(F.col("__qty") <= TOLERANCE, 0)
        .when(F.col("__cap").isNull(), 1)
        .when(F.col("__cap") <= 0, 0)
        .otherwise(F.ceil(F.try_divide(F.col("__qty"), F.col("__cap")) - 1e-9))
    ).cast("bigint")
    room = F.col("__stop") - F.col("__first")
    count = F.greatest(F.least(slices, room), F.lit(0)).cast("bigint")
    kept = [c for c in work.columns if not c.startswith("__")]
    listed = work.withColumn("__count", count).select(
        *kept,
        "__cap",
        "__qty",
        "__now",
        "__now_price",
        "__first",
        F.explode(
            F.when(
                F.col("__count") + (F.col("__now") > 0).cast("int") > 0,
                F.sequence(
                    F.when(F.col("__now") > 0, 0).otherwise(1).cast("bigint"), F.col("__count")
                ),
            )
        ).alias("__n"),
    )
    table = scanned.where(is_open).select(
        F.col("instrument_id").alias("__inst"),
        (F.col("count") - 1).alias("__pos"),
        F.col("at").alias("__open_at"),
        F.col("open").alias("__open"),
    )
    joined = listed.withColumn("__want", F.col("__first") + F.col("__n") - 1).join(
        table,
        (F.col("instrument_id") == F.col("__inst"))
        & (F.col("__want") == F.col("__pos"))
        & (F.col("__n") > 0),
        "left",
    )
    now = F.col("__n") == 0
    later_qty = F.when(F.col("__cap").isNull(), F.col("__qty")).otherwise(
        F.least(F.col("__cap"), F.col("__qty") - (F.col("__n") - 1) * F.col("__cap"))
    )
    return joined.where(now | F.col("__open_at").isNotNull()).select(
        *[c for c in kept if c != "quantity"],
        F.col("quantity").alias("order_quantity"),
        F.col("__n").cast("int").alias("fill_no"),
        F.when(now, F.col("eligible_at")).otherwise(F.col("__open_at")).alias("fill_at"),
        F.when(now, F.col("__now_price")).otherwise(F.col("__open")).alias("reference_price"),
        F.when(now, F.col("__now")).otherwise(later_qty).alias("quantity"),
    )


def unfilled(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Remaining quantity per order after all fills, where any is left."""
    done = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
    left = orders.join(done, "order_id", "left").withColumn(
        "remaining", F.col("quantity") - F.coalesce("filled", F.lit(0.0))
    )
    status = F.when(F.col("expires_at").isNotNull(), "expired").otherwise("cancelled")
    return left.where(F.col("remaining") > TOLERANCE).select(
        "order_id", "instrument_id", "remaining", status.alias("status")
    )


def scenario_table(names: Sequence[str] | None = None) -> Column:
    """The scenarios as an array of structs, to be exploded next to fills.

    A literal of at most eight entries: the rows multiply by that fixed number.
    """
    chosen = {n: SCENARIOS[n] for n in (names or SCENARIOS)}
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("scenario"),
                F.lit(c.half_spread_bps).alias("half_spread_bps"),
                F.lit(c.commission_bps).alias("commission_bps"),
                F.lit(c.slippage).alias("slippage_kind"),
                F.lit(c.coefficient).alias("coefficient"),
                F.lit(c.fallback_bps).alias("fallback_bps"),
                F.lit(c.fee_per_unit).alias("fee_per_unit"),
                F.lit(c.min_commission).alias("min_commission"),
            )
            for n, c in chosen.items()
        ]
    )


def with_scenarios(fills: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return fills.select("*", F.inline(scenario_table(names)))


def with_costs_of(fills: DataFrame, costs: Costs) -> DataFrame:
    """The same columns for one scenario that need not be named."""
    return fills.withColumns(
        {
            "half_spread_bps": F.lit(costs.half_spread_bps),
            "commission_bps": F.lit(costs.commission_bps),
            "slippage_kind": F.lit(costs.slippage),
            "coefficient": F.lit(costs.coefficient),
            "fallback_bps": F.lit(costs.fallback_bps),
            "fee_per_unit": F.lit(costs.fee_per_unit),
            "min_commission": F.lit(costs.min_commission),
        }
    )


def execution_costs(fills: DataFrame) -> DataFrame:
    """Half-spread, slippage, price, fee and participation of each fill.

    Reads the cost columns of :func:`with_scenarios`; plain column arithmetic.
    """
    ref, qty = F.col("reference_price"), F.col("quantity")
    liquidity = F.when(F.col("liquidity_estimate") != 0, F.col("liquidity_estimate"))
    share = F.try_divide(qty, liquidity)
    fallback = ref * F.col("fallback_bps") / 1e4
    kind, k = F.col("slippage_kind"), F.col("coefficient")
    linear = F.coalesce(ref * k / 1e4 * share, fallback)
    root = F.coalesce(ref * k * F.col("volatility_estimate") * F.sqrt(share), fallback)
    slip = (
        F.when(kind == "fixed_bps", ref * k / 1e4)
        .when(kind == "participation", linear)
        .when(kind == "sqrt_impact", root)
    )
    costed = fills.withColumns(
        {"half_spread": ref * F.col("half_spread_bps") / 1e4, "slippage": slip, "participation": share}
    )
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    priced = costed.withColumn("price", ref + sign * (F.col("half_spread") + F.col("slippage")))
    raw = qty * F.col("price") * F.col("commission_bps") / 1e4 + qty * F.col("fee_per_unit")
    return priced.withColumn("fee", F.greatest(raw, F.col("min_commission")))


def chain_violations(fills: DataFrame) -> DataFrame:
    """Fills whose signal, order, eligibility and fill times are out of order."""
    ok = (
        (F.col("signal_at") <= F.col("order_at"))
        & (F.col("order_at") <= F.col("eligible_at"))
        & (F.col("eligible_at") <= F.col("fill_at"))
    )
    return fills.where(~ok)
