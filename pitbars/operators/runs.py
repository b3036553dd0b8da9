"""Run-level tables: pivoted runs, comparison, agreement, parameter grids, report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions.scalars import time_bucket
from pitbars.operators.metrics import period_path
from pitbars.operators.ordered import running
from pitbars.operators.resample import periodic_equity
from pitbars.types import DAY

ROLES = ("validation", "test")
# The metric names of a run table.
METRICS = (
    "periods",
    "total_return",
    "annualized_return",
    "annualized_volatility",
    "sharpe",
    "max_drawdown",
    "turnover_annualized",
    "avg_gross_exposure",
    "avg_net_exposure",
    "order_count",
    "fill_count",
    "period_hit_rate",
    "total_costs",
    "cost_fraction",
    "mean_participation",
    "warning_count",
)


def run_table(
    identity: DataFrame, metrics: DataFrame, *, run: str = "run_id",
    columns: Sequence[str] = METRICS,
) -> DataFrame:
    """One row per run: identity and assumptions, then each role's metrics as columns."""
    present = [c for c in columns if c in metrics.columns]
    wide = metrics.groupBy(run).pivot("role", list(ROLES)).agg(*[F.first(c).alias(c) for c in present])
    return identity.join(wide, run, "left")


def fold_table(metrics: DataFrame, folds: DataFrame, *, run: str = "run_id") -> DataFrame:
    """One row per run, fold and role with that fold's range."""
    spans = folds.where(F.col("role").isin(*ROLES))
    return metrics.join(spans, ["fold", "role"])


def compare(table: DataFrame, runs: Sequence[str] | None = None, *, role: str = "test",
            run: str = "run_id") -> DataFrame:
    """Runs side by side for one role: its metrics lose the prefix, the other role's go."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    rows = table if runs is None else table.where(F.col(run).isin(list(runs)))
    prefix = f"{role}_"
    plain = [c for c in table.columns if not c.startswith(tuple(f"{r}_" for r in ROLES))]
    mine = [
        F.col(c).alias(c.removeprefix(prefix))
        for c in table.columns
        if c.startswith(prefix) and c.removeprefix(prefix) not in plain
    ]
    return rows.select(*plain, F.lit(role).alias("role"), *mine)


def agreement(a: DataFrame, b: DataFrame, *, on: Sequence[str], columns: Sequence[str],
              rtol: float = 1e-9) -> DataFrame:
    """Per key and metric: exact, within_tolerance, different, or missing."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in columns
        ]
        return df.select(*on, F.inline(F.array(*pairs)))

    joined = long(a, "a").join(long(b, "b"), [*on, "metric"], "full")
    va, vb = F.col("a"), F.col("b")
    near = F.abs(va - vb) <= rtol * F.greatest(F.abs(va), F.abs(vb))
    verdict = (
        F.when(va.eqNullSafe(vb), "exact")
        .when(va.isNull() | vb.isNull(), "missing")
        .when(near, "within_tolerance")
        .otherwise("different")
    )
    return joined.select(*on, "metric", verdict.alias("agreement"))


def with_grid(df: DataFrame, axes: Sequence[Sequence[Column]], *, trial: str = "trial") -> DataFrame:
    """Every row once per combination of the axes, numbered by ``trial``.

    An axis is a list of structs; its fields move together. Later axes vary fastest, and the
    number of combinations is that of the configuration, not of the data.
    """
    sizes = [len(axis) for axis in axes]
    number = F.lit(0)
    out = df
    for i, axis in enumerate(axes):
        kept = [c for c in out.columns if not c.startswith("__at")]
        out = out.select(*kept, *[f"__at{j}" for j in range(i)], F.posexplode(F.array(*axis)).alias(f"__at{i}", "__point"))
        out = out.select(*kept, *[f"__at{j}" for j in range(i + 1)], "__point.*")
        number = number * sizes[i] + F.col(f"__at{i}")
    plain = [c for c in out.columns if not c.startswith("__at")]
    return out.select(number.cast("int").alias(trial), *plain)


def rank_trials(
    table: DataFrame, *, by: str = "validation_total_return", trial: str = "trial",
    ties: Sequence[str] = ("trial", "fill_rule", "scenario"),
) -> DataFrame:
    """Rows from best to worst on validation, with how many trials were tried."""
    tried = table.agg(F.count_distinct(trial)).scalar()
    order = [c for c in ties if c in table.columns]
    return table.withColumn("trials", tried).orderBy(F.col(by).desc_nulls_last(), *order)


def best_and_worst(trades: DataFrame, *, k: int = 5, keys: Sequence[str] = (),
                   value: str = "net_pnl", tiebreak: Sequence[str] = ("trade_no",)) -> DataFrame:
    """The ``k`` largest and ``k`` smallest closed trades; a trade in both is listed once."""
    closed = trades.where(~F.col("is_open"))
    named = list(keys) or [F.lit(0)]

    def ranked(order: Column) -> DataFrame:
        w = Window.partitionBy(*named).orderBy(order, *tiebreak)
        top = closed.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
        return top.drop("__n")

    return ranked(F.col(value).desc()).unionByName(ranked(F.col(value).asc())).distinct()


def report_series(curve: DataFrame, *, keys: Sequence[str], bar_size: str) -> DataFrame:
    """Equity from one, drawdown from zero down, and gross exposure over equity, per period.

    One series per key, so that folds do not run into each other.
    """
    periods = periodic_equity(
        curve.select(*keys, "at", "equity", "gross_exposure"), keys=list(keys), bar_size=bar_size
    )
    path = running(
        period_path(periods, keys=list(keys)), list(keys), ["period"],
        time_bucket("period", 30 * DAY), firsts={"__base": F.col("equity")},
    )
    return path.select(
        *keys,
        "period",
        F.try_divide(F.col("equity"), F.col("__base")).alias("equity_index"),
        (-F.col("drawdown")).alias("drawdown"),
        F.try_divide(F.col("gross_exposure"), F.col("equity")).alias("exposure"),
    )


def preview(folds: DataFrame, *, scenarios: int = 1, fill_rules: int = 1, trials: int = 1) -> DataFrame:
    """How much work a plan asks for: folds, evaluated roles, and simulated passes."""
    passes = scenarios * fill_rules * trials
    return folds.agg(
        F.count_distinct("fold").alias("folds"),
        F.count_if(F.col("role").isin(*ROLES)).alias("evaluated"),
        (F.count_if(F.col("role").isin(*ROLES)) * passes).alias("passes"),
    )
