"""Fold-owned scaling and clipping: statistics are a table, fitting is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import clip
from pitbars.operators.ordered import group_totals, ranged, running
from pitbars.types import require_columns


def _check_train(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(rows, ["fold", "split_role", *columns], "fit")
    role = F.col("split_role")
    refuse = F.raise_error(F.concat(F.lit("cannot fit on role "), role))
    return rows.where(F.when(role == "train", True).otherwise(refuse))


def fit_zscore(rows: DataFrame, columns: Sequence[str], *, ddof: int = 1) -> DataFrame:
    """``fold, column, mean, std`` from training rows; a missing deviation counts as zero."""
    long = _melt(_check_train(rows, columns), columns)
    n = F.count("value")
    spread = F.sqrt(F.try_divide(F.var_pop("value") * n, n - F.lit(ddof)))
    std = {0: F.stddev_pop("value"), 1: F.stddev_samp("value")}.get(ddof, spread)
    return long.groupBy("fold", "column").agg(
        F.avg("value").alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std"), n.alias("rows")
    )


def fit_winsor(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    lower: float = 0.01,
    upper: float = 0.99,
    accuracy: int | None = None,
) -> DataFrame:
    """``fold, column, lower, upper`` quantiles, interpolated linearly.

    Exact by default, by locating the order statistics in a value-count table with running
    counts, so no task holds all values of a fold. ``accuracy`` opts in to the approximate
    sketch instead.
    """
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError("need 0 <= lower < upper <= 1")
    long = _melt(_check_train(rows, columns), columns)
    if accuracy is not None:
        return long.groupBy("fold", "column").agg(
            F.percentile_approx("value", lower, accuracy).alias("lower"),
            F.percentile_approx("value", upper, accuracy).alias("upper"),
        )
    return exact_quantiles(long, ["fold", "column"], "value", {"lower": lower, "upper": upper})


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per key over any number of values.

    Equal values are counted first; the counts are cut into ranges of values and summed up
    along them, so neither a key nor a repeated value is one task's work.
    """
    counts = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cut = ranged(counts, keys, ["__v"])
    placed = running(cut, keys, ["__v"], F.col("__part"), sums={"__upto": F.col("__n")})
    joined = group_totals(placed, list(keys), F.col("__part"), sums={"__total": F.col("__n")})
    first = F.col("__upto") - F.col("__n")
    picks, mixes = [], []
    for name, p in wanted.items():
        spot = F.lit(p) * (F.col("__total") - 1)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("__total") - 1)
        picks += [
            F.max(F.when((first <= low) & (low < F.col("__upto")), F.col("__v"))).alias(f"__a_{name}"),
            F.max(F.when((first <= high) & (high < F.col("__upto")), F.col("__v"))).alias(f"__b_{name}"),
            F.max(spot - low).alias(f"__w_{name}"),
        ]
        a, b, w = (F.col(f"__{x}_{name}") for x in "abw")
        mixes.append((a + (b - a) * w).alias(name))
    return joined.groupBy(*keys).agg(*picks).select(*keys, *mixes)


def apply_zscore(rows: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale per fold; null where the training deviation was zero."""
    wide = _widen(stats, columns, ["mean", "std"])
    joined = rows.join(wide, "fold")
    scaled = {
        c: F.when(F.col(f"__std_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__std_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).select(*rows.columns)


def apply_winsor(rows: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip per fold to the training quantiles."""
    wide = _widen(stats, columns, ["lower", "upper"])
    joined = rows.join(wide, "fold")
    clipped = {c: clip(F.col(c), F.col(f"__lower_{c}"), F.col(f"__upper_{c}")) for c in columns}
    return joined.withColumns(clipped).select(*rows.columns)


def _melt(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return rows.select("fold", F.inline(F.array(*pairs)))


def _widen(stats: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per fold: a metadata-sized table Spark broadcasts by its measured size."""
    picks = [
        F.max(F.when(F.col("column") == c, F.col(n))).alias(f"__{n}_{c}")
        for c in columns
        for n in names
    ]
    return stats.groupBy("fold").agg(*picks)
