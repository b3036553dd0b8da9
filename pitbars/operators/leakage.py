"""Property checks: does a feature see past its declared availability?

All cut points run in one job: rows are listed under every cut they concern and the cut
becomes one more partition key of the feature computation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import differs, instant, time_bucket
from pitbars.operators.ordered import running
from pitbars.types import DAY

# What corrupted inputs are set to.
SENTINEL_PRICE = 1.0e9
SENTINEL_VOLUME = 1.0e12
PRICE_COLUMNS = ("open", "high", "low", "close", "vwap")
VOLUME_COLUMNS = ("volume", "trade_count")

KEY = ["cut", "instrument_id", "bar_start"]
Compute = Callable[[DataFrame], DataFrame]


def cut_points(bars: DataFrame, count: int = 5) -> DataFrame:
    """Evenly spaced interior availabilities, one row per cut, at most ``count``.

    Order statistics come from running counts over distinct instants.
    """
    counts = bars.groupBy("available_at").agg(F.count(F.lit(1)).alias("n"))
    one = counts.withColumn("__one", F.lit(0))
    placed = running(
        one, ["__one"], ["available_at"], time_bucket("available_at", DAY), sums={"upto": F.col("n")}
    )
    total = counts.agg(F.sum("n")).scalar()
    spots = F.array(
        *[F.floor(F.col("__total") * (i + 1) / (count + 1)).cast("bigint") for i in range(count)]
    )
    hit = F.exists(spots, lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    return placed.withColumn("__total", total).where(hit).select(F.col("available_at").alias("cut"))


def _cut_array(cuts: DataFrame | Sequence[dt.datetime]):
    """Cuts as a literal array. Their number is a parameter of the check, not of the data."""
    if isinstance(cuts, DataFrame):
        moments = [r["us"] for r in cuts.select(F.unix_micros("cut").alias("us")).collect()]
        return F.array(*[F.timestamp_micros(F.lit(m)) for m in sorted(moments)])
    return F.array(*[instant(c) for c in cuts])


def _full(bars: DataFrame, compute: Compute, cuts: Column) -> DataFrame:
    """What the full data gives, computed once and listed under every cut it is known at."""
    once = compute(bars.withColumn("cut", F.timestamp_micros(F.lit(0)))).drop("cut")
    return once.withColumn("cut", F.explode(cuts)).where(F.col("available_at") <= F.col("cut"))


def prefix_violations(
    bars: DataFrame, compute: Compute, cuts, *, rtol: float = 1e-9
) -> DataFrame:
    """Rows whose value from the full data differs from the value the prefix gives.

    ``compute`` must treat ``cut`` as a partition key and return ``cut``, ``instrument_id``,
    ``bar_start``, ``available_at`` and the feature columns.
    """
    moments = _cut_array(cuts)
    listed = bars.withColumn("cut", F.explode(moments))
    prefix = compute(listed.where(F.col("available_at") <= F.col("cut")))
    return _compare(_full(bars, compute, moments), prefix, rtol, absent_counts=True)


def future_violations(
    bars: DataFrame, compute: Compute, cuts, *, rtol: float = 1e-9
) -> DataFrame:
    """Rows that move, in value or availability, when only later bars are corrupted."""
    moments = _cut_array(cuts)
    listed = bars.withColumn("cut", F.explode(moments))
    later = F.col("available_at") > F.col("cut")
    kinds = dict(bars.dtypes)
    poison = {c: SENTINEL_PRICE for c in PRICE_COLUMNS if c in kinds}
    poison |= {c: SENTINEL_VOLUME for c in VOLUME_COLUMNS if c in kinds}
    corrupted = listed.withColumns(
        {c: F.when(later, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in poison.items()}
    )
    return _compare(_full(bars, compute, moments), compute(corrupted), rtol, absent_counts=False)


def _compare(full: DataFrame, other: DataFrame, rtol: float, *, absent_counts: bool) -> DataFrame:
    values = [c for c in full.columns if c not in (*KEY, "available_at")]
    right = other.select(
        *[F.col(k).alias(f"__{k}") for k in KEY],
        *[F.col(c).alias(f"__{c}") for c in [*values, "available_at"]],
    )
    on = [F.col(k) == F.col(f"__{k}") for k in KEY]
    joined = full.join(right, on, "left")
    absent = F.col("__available_at").isNull()
    failed = [
        F.when(~absent & differs(F.col(c).cast("double"), F.col(f"__{c}").cast("double"), rtol), F.lit(c))
        for c in values
    ]
    if absent_counts:
        failed.append(F.when(absent, F.lit("(row absent)")))
    else:
        moved = F.col("available_at") != F.col("__available_at")
        failed.append(F.when(moved, F.lit("(availability moved)")))
    return joined.select(*KEY, "available_at", F.explode(F.array_compact(F.array(*failed))).alias("feature"))


def assert_no_leak(violations: DataFrame) -> None:
    """Raise with up to ten offending rows."""
    rows = violations.limit(10).collect()
    if rows:
        raise AssertionError(f"feature reads the future, for example {rows}")
