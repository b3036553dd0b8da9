"""Open-loop backtest: features to metrics for many parameter points in one job.

Sizes come from the initial capital, not from running equity, which is what makes the whole
computation a set operation; results carry ``sizing = 'initial_capital'`` to say so. A
parameter point, a cost scenario, and a fill rule are rows, so a sweep is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import floor_to_increment, time_bucket
from pitbars.operators import execution as ex
from pitbars.operators.joins import interval_join
from pitbars.operators.ledger import equity_curve
from pitbars.operators.metrics import Annualization, annualization_for, in_decision_range, performance
from pitbars.operators.ordered import running
from pitbars.operators.rangeend import close_accounts
from pitbars.session import staged
from pitbars.types import DAY


@dataclass(frozen=True)
class Setup:
    bar_size: str
    initial_cash: float = 100_000.0
    increment: float = 1e-6
    execution: ex.Execution = ex.Execution()
    fill_rules: Sequence[str] = ex.FILL_RULES
    scenarios: Sequence[str] | None = None
    calendar_id: str = "24x7:1"
    #: ``mark`` or ``liquidate`` (:mod:`pitbars.operators.rangeend`); without one, orders fill as
    #: long as there are opens and nothing is reported about the end.
    end_of_range: str | None = None

    def annualization(self) -> Annualization:
        return annualization_for(self.calendar_id, self.bar_size)


def orders_from_targets(
    targets: DataFrame, bars: DataFrame, estimates: DataFrame, setup: Setup, *, run: Sequence[str]
) -> DataFrame:
    """Orders that move each instrument to its target weight of the initial capital.

    The target is priced at the close of the row that publishes it, and an order is the
    change of the target quantity since the run's previous row of that instrument.
    """
    closes = bars.select("instrument_id", "bar_start", "close")
    priced = targets.join(closes, ["instrument_id", "bar_start"])
    wanted = F.try_divide(F.col("target") * setup.initial_cash, F.col("close"))
    sized = priced.withColumn(
        "wanted", floor_to_increment(wanted, F.lit(setup.increment), 1e-9)
    )
    seen = running(
        sized, [*run, "instrument_id"], ["decision_at", "bar_start"],
        time_bucket("decision_at", DAY), lags={"__before": F.col("wanted")},
    )
    change = F.col("wanted") - F.coalesce("__before", F.lit(0.0))
    moved = seen.withColumn("change", change).where(F.abs("change") > setup.increment / 2)
    orders = moved.join(
        estimates.select("instrument_id", "bar_start", "liquidity_estimate", "volatility_estimate"),
        ["instrument_id", "bar_start"], "left",
    ).select(
        *run, "instrument_id", "bar_start",
        F.col("decision_at").alias("signal_at"),
        F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"),
        F.abs("change").alias("quantity"),
        F.lit(setup.increment).alias("increment"),
        "liquidity_estimate", "volatility_estimate",
    )
    timed = ex.order_times(orders, setup.execution)
    return timed.withColumn(
        "order_id",
        F.concat_ws("|", *[F.col(c).cast("string") for c in run], "instrument_id",
                    F.unix_micros("signal_at").cast("string"), F.unix_micros("bar_start").cast("string")),
    )


def matched_under(orders: DataFrame, bars: DataFrame, setup: Setup) -> DataFrame:
    """Fills for every fill rule of the setup, before costs."""
    matched = None
    for rule in setup.fill_rules:
        part = ex.match_orders(orders, bars, replace(setup.execution, fill_rule=rule), step=setup.bar_size).withColumn(
            "fill_rule", F.lit(rule)
        )
        matched = part if matched is None else matched.unionByName(part)
    return matched


def _closed(
    orders: DataFrame, matched: DataFrame, bars: DataFrame, spans: DataFrame, setup: Setup, base: Sequence[str]
) -> dict[str, DataFrame]:
    """The end-of-range policy of the setup, rule by rule."""
    out: dict[str, DataFrame] = {}
    for rule in setup.fill_rules:
        part = close_accounts(
            orders.withColumn("fill_rule", F.lit(rule)), matched.where(F.col("fill_rule") == rule), bars, spans,
            replace(setup.execution, fill_rule=rule), policy=setup.end_of_range, step=setup.bar_size,
            account=[*base, "fill_rule"], increment=setup.increment,
        )
        out = part if not out else {name: out[name].unionByName(df) for name, df in part.items()}
    return out


def backtest(
    targets: DataFrame, bars: DataFrame, folds: DataFrame, setup: Setup, *, run: Sequence[str] = (),
    roles: Sequence[str] = ("test",), accounts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Ledgers and metrics per run, fill rule, scenario, fold and role.

    ``targets``: run columns, ``instrument_id, decision_at, bar_start, target``. Every fold
    and role is its own account: decisions inside its range trade. With an end-of-range policy
    the result also has its ``events, findings`` and ``positions``. ``accounts`` (run columns, ``fold, role``) lists those that get a curve and
    a metric row although they may never trade; without it, they are the ones with fills.
    """
    spans = staged(folds.where(F.col("role").isin(list(roles))), "folds")
    placed = interval_join(
        targets, spans.select("fold", "role", "start", "end"), at="decision_at"
    ).drop("start", "end")
    base = [*run, "fold", "role"]
    estimates = ex.liquidity_estimates(bars, setup.execution.liquidity_lookback)
    orders = staged(orders_from_targets(placed, bars, estimates, setup, run=base), "orders")
    ended: dict[str, DataFrame] = {}
    matched = matched_under(orders, bars, setup)
    if setup.end_of_range is not None:
        ended = _closed(orders, staged(matched, "matched"), bars, spans, setup, base)
        matched = ended.pop("fills")
    fills = staged(ex.execution_costs(ex.with_scenarios(matched, setup.scenarios)), "fills")
    account = [*base, "fill_rule", "scenario"]
    marks = interval_join(
        bars.select("instrument_id", F.col("available_at").alias("at"), F.col("close").alias("price")),
        spans.select("fold", "role", "start", "end"), at="at",
    ).drop("start", "end")
    rules = F.explode(F.array(*[F.lit(r) for r in setup.fill_rules]))
    scenarios = F.explode(F.array(*[F.lit(s) for s in (setup.scenarios or ex.SCENARIOS)]))

    def under_each(rows: DataFrame) -> DataFrame:
        return rows.withColumn("fill_rule", rules).withColumn("scenario", scenarios)

    if accounts is not None:
        accounts = under_each(accounts.where(F.col("role").isin(list(roles))).select(*base))
    curve = staged(
        equity_curve(
            fills, marks, initial_cash=setup.initial_cash, run=account,
            fill_order=["fill_at", "order_id", "fill_no"], accounts=accounts,
        ),
        "curve",
    )
    ranged = in_decision_range(curve, spans, ["fold", "role"])
    metrics = performance(
        ranged, keys=account, bar_size=setup.bar_size, annualization=setup.annualization(),
        fills=fills, orders=under_each(orders),
    ).withColumn("sizing", F.lit("initial_capital"))
    return {"orders": orders, "fills": fills, "equity_curve": curve, "metrics": metrics, **ended}
