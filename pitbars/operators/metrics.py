"""Performance metrics, drawdown, trade statistics, and curve stitching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions.scalars import elapsed, time_bucket
from pitbars.operators.ordered import group_totals, running
from pitbars.operators.resample import periodic_equity
from pitbars.types import DAY, MINUTE, micros

# Trading minutes per year of each calendar.
MINUTES_PER_YEAR = {"24x7": 365.25 * 1440, "XNYS": 252 * 390.0}
#: A period's return up to this is what running sums leave of nothing, and no gain.
RESIDUE = 1e-9


@dataclass(frozen=True)
class Annualization:
    periods_per_year: float
    label: str
    risk_free_rate: float = 0.0


def annualization_for(calendar_id: str, bar_size: str) -> Annualization:
    venue = calendar_id.split(":")[0]
    if venue not in MINUTES_PER_YEAR:
        raise KeyError(f"no annualisation policy for calendar {calendar_id!r}")
    periods = MINUTES_PER_YEAR[venue] / (micros(bar_size) / MINUTE)
    return Annualization(periods, f"{venue}, {bar_size} bars: {periods:.0f} periods/year")


def in_decision_range(curve: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshots inside their key's ``[start, end)``; ranges have one row per key."""
    joined = curve.join(ranges.select(*keys, "start", "end"), list(keys))
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    return joined.where(inside).drop("start", "end")


def period_path(periods: DataFrame, *, keys: Sequence[str], width: int = 30 * DAY) -> DataFrame:
    """Per period: ``ret`` and ``previous_gross``, and the running peak with its drawdown.

    The peak and its time are one running maximum of ``(equity, period)``: equal equity at a
    later period moves the peak there. One scan serves all columns.
    """
    lags = {"__equity0": F.col("equity")}
    if "gross_exposure" in periods.columns:
        lags["previous_gross"] = F.col("gross_exposure")
    out = running(
        periods, list(keys), ["period"], time_bucket("period", width),
        maxs={"__peak": F.struct("equity", "period")}, lags=lags,
    )
    peak = F.col("__peak.equity")
    below = F.col("equity") < peak
    return out.withColumns(
        {
            "ret": F.try_divide(F.col("equity"), F.col("__equity0")) - 1,
            "peak": peak,
            "peak_at": F.col("__peak.period"),
            "drawdown": F.when(below, 1 - F.col("equity") / peak).otherwise(0.0),
            "under_water_us": F.when(below, elapsed("period", "__peak.period")).otherwise(0),
        }
    ).drop("__peak", "__equity0")


def performance(
    curve: DataFrame,
    *,
    keys: Sequence[str],
    bar_size: str,
    annualization: Annualization,
    fills: DataFrame | None = None,
    orders: DataFrame | None = None,
    warnings: DataFrame | None = None,
    trades: DataFrame | None = None,
) -> DataFrame:
    """One metric row per key from its equity curve and ledgers.

    With ``trades`` (:func:`pitbars.operators.ledger.trades`, carrying the keys) the row also
    has their statistics, each under ``trades_``; keys without trades have zero counts.

    Restrict the curve to the decision range first (:func:`in_decision_range`); flat
    stretches outside it dilute every rate.
    """
    keys = list(keys)
    periods = periodic_equity(
        curve.select(*keys, "at", "equity", "gross_exposure", "net_exposure"),
        keys=keys, bar_size=bar_size,
    )
    rows = period_path(periods, keys=keys)
    ppy = float(annualization.periods_per_year)
    rf = annualization.risk_free_rate / ppy
    exposed = F.col("previous_gross") > 0
    base = rows.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("periods"),
        F.min_by("equity", "period").alias("start_equity"),
        F.max_by("equity", "period").alias("end_equity"),
        F.avg("ret").alias("__mean"),
        F.stddev_samp("ret").alias("__std"),
        F.count("ret").alias("__rets"),
        F.max("drawdown").alias("max_drawdown"),
        F.max("under_water_us").alias("max_drawdown_us"),
        F.avg("equity").alias("__mean_equity"),
        F.avg(F.try_divide(F.col("gross_exposure"), F.col("equity"))).alias("avg_gross_exposure"),
        F.avg(F.try_divide(F.col("net_exposure"), F.col("equity"))).alias("avg_net_exposure"),
        F.avg(F.when(exposed, (F.col("ret") > RESIDUE).cast("double"))).alias("period_hit_rate"),
    )
    base = _attach(base, _fill_totals(fills, keys), keys, _FILL_ZEROS)
    base = _attach(base, _count(orders, keys, "order_count"), keys, {"order_count": 0})
    warned = None if warnings is None else warnings.groupBy(*keys).agg(
        F.sum("occurrences").alias("warning_count")
    )
    base = _attach(base, warned, keys, {"warning_count": 0})
    told = []
    if trades is not None:
        stats = trade_statistics(trades, keys)
        named = {c: f"trades_{c}" for c in stats.columns if c not in keys}
        told = list(named.values())
        counts = {named[c]: 0 for c in ("trade_count", "open_at_end", "long_count", "short_count")}
        base = _attach(base, stats.withColumnsRenamed(named), keys, counts)
    n, start, end = F.col("periods"), F.col("start_equity"), F.col("end_equity")
    std = F.when(F.col("__rets") >= 2, F.col("__std"))
    growth = F.try_divide(end, start)
    ok = (n > 0) & (start > 0)
    return base.select(
        *keys,
        "periods", "start_equity", "end_equity",
        F.when(start > 0, growth - 1).otherwise(0.0).alias("total_return"),
        F.when(ok, F.pow(growth, F.lit(ppy) / n) - 1).alias("annualized_return"),
        (std * F.sqrt(F.lit(ppy))).alias("annualized_volatility"),
        F.when(std > 0, (F.col("__mean") - rf) / std * F.sqrt(F.lit(ppy))).alias("sharpe"),
        "max_drawdown", "max_drawdown_us",
        F.when(
            (n > 0) & (F.col("__mean_equity") > 0),
            F.col("notional") / F.col("__mean_equity") * ppy / n,
        ).alias("turnover_annualized"),
        "avg_gross_exposure", "avg_net_exposure",
        "order_count", "fill_count", "period_hit_rate", "total_costs",
        F.when(start > 0, F.col("total_costs") / start).otherwise(0.0).alias("cost_fraction"),
        "mean_participation", "warning_count",
        F.lit(ppy).alias("periods_per_year"),
        *told,
    )


_FILL_ZEROS = {"fill_count": 0, "total_costs": 0.0, "notional": 0.0, "mean_participation": None}


def _fill_totals(fills: DataFrame | None, keys: Sequence[str]) -> DataFrame | None:
    if fills is None:
        return None
    return cost_split(fills, keys).select(
        *keys, "fill_count", "total_costs", "notional", "mean_participation"
    )


def _count(rows: DataFrame | None, keys: Sequence[str], name: str) -> DataFrame | None:
    return None if rows is None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _attach(base: DataFrame, extra: DataFrame | None, keys: Sequence[str], empty: dict) -> DataFrame:
    """Join per-key totals; keys without any take the stated empty values."""
    kinds = {int: "bigint", float: "double", type(None): "double"}
    if extra is None:
        return base.withColumns({c: F.lit(v).cast(kinds[type(v)]) for c, v in empty.items()})
    joined = base.join(extra, list(keys), "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in empty.items() if v is not None}
    )


def cost_split(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread, slippage and fee totals, notional, and mean participation per key."""
    q = F.col("quantity")
    share = F.avg("participation") if "participation" in fills.columns else F.lit(None).cast("double")
    return fills.groupBy(*keys).agg(
        F.sum(q * F.col("half_spread")).alias("spread_cost"),
        F.sum(q * F.col("slippage")).alias("slippage_cost"),
        F.sum("fee").alias("fee_cost"),
        F.sum(q * (F.col("half_spread") + F.col("slippage")) + F.col("fee")).alias("total_costs"),
        F.sum(q * F.col("price")).alias("notional"),
        F.count(F.lit(1)).alias("fill_count"),
        share.alias("mean_participation"),
    )


def trade_statistics(
    trades: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Statistics of closed trades per key; open ones are only counted.

    The median is exact and found from running counts, not by sorting a key in one task.
    """
    from pitbars.operators.transforms import exact_quantiles

    named = list(keys) or ["__all"]
    rows = trades if keys else trades.withColumn("__all", F.lit(0))
    closed, net = ~F.col("is_open"), F.col("net_pnl")
    won, lost = closed & (net > 0), closed & (net < 0)
    when = lambda cond, c: F.when(cond, c)
    stats = rows.groupBy(*named).agg(
        F.count_if(closed).alias("trade_count"),
        F.count_if(F.col("is_open")).alias("open_at_end"),
        F.count_if(won).alias("__wins"),
        F.avg(when(won, net)).alias("average_win"),
        F.avg(when(lost, net)).alias("average_loss"),
        F.sum(when(won, net)).alias("__won"),
        F.sum(when(lost, net)).alias("__lost"),
        F.avg(when(closed, net)).alias("expectancy"),
        F.max(when(closed, net)).alias("largest_win"),
        F.min(when(closed, net)).alias("largest_loss"),
        F.coalesce(F.sum(when(closed, F.col("gross_pnl"))), F.lit(0.0)).alias("gross_pnl"),
        F.coalesce(F.sum(when(closed, F.col("costs"))), F.lit(0.0)).alias("costs"),
        F.coalesce(F.sum(when(closed, net)), F.lit(0.0)).alias("net_pnl"),
        F.count_if(closed & (F.col("direction") == "long")).alias("long_count"),
        F.count_if(closed & (F.col("direction") == "short")).alias("short_count"),
    )
    median = exact_quantiles(rows.where(closed), named, "duration_s", {"median_duration_s": 0.5})
    out = stats.join(median, named, "left")
    return out.select(
        *keys,
        "trade_count", "open_at_end",
        F.try_divide(F.col("__wins").cast("double"), F.col("trade_count").cast("double")).alias("win_rate"),
        "average_win", "average_loss",
        F.when(
            F.col("__lost") < 0, F.coalesce("__won", F.lit(0.0)) / F.abs("__lost")
        ).alias("profit_factor"),
        "expectancy", "median_duration_s", "largest_win", "largest_loss",
        "gross_pnl", "costs", "net_pnl", "long_count", "short_count",
    )


def stitch(curves: DataFrame, *, keys: Sequence[str] = ("role",), fold: str = "fold") -> DataFrame:
    """Chain fold curves so that each starts where the one before ended.

    Every fold is reduced to its start and end (one row); its scale is the product of end
    over start of the folds before it. A fold that starts at zero cannot be scaled: it keeps
    its own numbers, and the folds after it chain from its end.
    """
    keys = list(keys)
    ends = curves.groupBy(*keys, fold).agg(
        F.min("at").alias("__t0"),
        F.min_by("equity", "at").alias("__start"),
        F.max_by("equity", "at").alias("__end"),
    )
    w = Window.partitionBy(*keys).orderBy("__t0", fold)
    zero = F.col("__start") == 0
    chains = ends.withColumn("__chain", F.sum(zero.cast("int")).over(w))
    within = Window.partitionBy(*keys, "__chain").orderBy("__t0", fold)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    # A chain begins at its first start, or at the end of the fold that started at zero.
    opening = F.first(F.when(zero, F.col("__end")).otherwise(F.col("__start"))).over(
        within.rowsBetween(Window.unboundedPreceding, 0)
    )
    ratio = F.when(zero, F.lit(1.0)).otherwise(F.try_divide(F.col("__end"), F.col("__start")))
    scaled = chains.withColumn("__ratio", ratio).withColumns(
        {"__scale": F.coalesce(F.product("__ratio").over(earlier), F.lit(1.0)), "__base": opening}
    )
    factor = F.when(zero, F.lit(1.0)).otherwise(
        F.try_divide(F.col("__scale") * F.col("__base"), F.col("__start"))
    )
    joined = curves.join(scaled.select(*keys, fold, factor.alias("__f")), [*keys, fold])
    money = [c for c in ("equity", "gross_exposure", "net_exposure", "cash") if c in curves.columns]
    return joined.withColumns({c: F.col(c) * F.col("__f") for c in money}).drop("__f")


def histogram(rows: DataFrame, value: str, *, bins: int = 31, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over ``[min, max]``, empty bins included.

    The maximum falls in the last bin. Missing and NaN values are left out. Ranges are one row
    per key and meet the rows by an equi-join; counts combine before their shuffle.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    data = rows.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull())
    ranges = data.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    margin = F.when(F.col("__lo") == F.col("__hi"), 1.0).otherwise(0.0)
    ranges = ranges.where(F.col("__lo").isNotNull()).select(
        *keys, (F.col("__lo") - margin).alias("__lo"), (F.col("__hi") + margin).alias("__hi")
    )
    step = (F.col("__hi") - F.col("__lo")) / bins
    if keys:
        spanned = data.join(ranges, list(keys))
    else:
        low, high = (ranges.select(c).scalar() for c in ("__lo", "__hi"))
        spanned = data.withColumns({"__lo": low, "__hi": high})
    index = F.least(F.floor((F.col("__v") - F.col("__lo")) / step), F.lit(bins - 1)).cast("int")
    counted = spanned.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return empty.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("__lo") + step * F.col("bin")).alias("bin_low"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def downsample(
    series: DataFrame, *, at: str, value: str, limit: int = 1400, keys: Sequence[str] = (),
    width: int = DAY,
) -> DataFrame:
    """At most ``limit`` points (plus endpoints) that keep each stretch's extremes.

    Points are bucketed by position; every bucket keeps its minimum and maximum, and the
    first and last point always stay. Short series pass unchanged.
    """
    named = list(keys) or ["__all"]
    rows = series.select(*keys, at, value) if keys else series.select(at, value).withColumn("__all", F.lit(0))
    placed = running(
        rows, named, [at], time_bucket(at, width), sums={"__n": F.lit(1).cast("bigint")}
    )
    joined = group_totals(
        placed, named, time_bucket(at, width), sums={"__total": F.lit(1).cast("bigint")}
    ).withColumn("__i", F.col("__n") - 1)
    buckets = max(limit // 2, 1)
    # Bucket b holds positions from int(b * total / buckets); integers keep that exact.
    bucket = bucket_of_ratio("__i", "__total", buckets)
    long = F.col("__total") > limit
    spot = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    ends = (F.col("__i") == 0) | (F.col("__i") == F.col("__total") - 1)
    kept = joined.withColumn("__bucket_no", F.when(long, bucket)).where(long)
    extremes = kept.groupBy(*named, "__bucket_no").agg(
        F.min_by(spot, F.struct(F.col(value), F.col("__i"))).alias("a"),
        F.max_by(spot, F.struct(F.col(value), -F.col("__i"))).alias("b"),
    )
    picked = extremes.select(*named, F.explode(F.array("a", "b")).alias("p"))
    whole = joined.where(~long | ends).select(*named, spot.alias("p"))
    points = picked.unionByName(whole).distinct()
    return points.select(*keys, F.col("p.at").alias(at), F.col("p.value").alias(value))


def bucket_of_ratio(index: str, total: str, buckets: int):
    """Bucket whose start ``floor(b * total / buckets)`` is the last at or before the index.

    ``b * total <= (index + 1) * buckets - 1`` in integers, so b is one floor division.
    """
    return F.expr(f"(({index} + 1) * {buckets} - 1) div {total}")
