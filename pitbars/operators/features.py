"""The feature pipeline: values, gap gate, and row availability in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pitbars.functions.features import FeatureSpec, Step, ordered_steps, step_column
from pitbars.functions.scalars import elapsed, time_bucket
from pitbars.operators.ordered import CHUNK_ROWS, rolling
from pitbars.types import micros, require_columns

KEY = ["instrument_id", "bar_start"]


def compute_features(
    bars: DataFrame,
    features: Sequence[FeatureSpec],
    *,
    bar_size: str,
    keys: Sequence[str] = ("instrument_id",),
    keep: Sequence[str] = (),
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Feature values per bar, with the instant each row may be used.

    A value is null when its feature asks for consecutive bars and the bars behind it skip
    the grid. A row is available once its slowest input and every declared computation
    latency have passed. ``keys`` may carry extra partition columns (a cut, a run).
    All features share one window, so Spark sorts each chunk once. Steps that features declare
    come first, stage by stage, each once.
    """
    if not features:
        raise ValueError("no features requested")
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate feature names in {names}")
    inputs = sorted({c for f in features for c in f.inputs})
    needed = list(dict.fromkeys([*keys, *KEY, "available_at", "bar_size", *inputs, *keep]))
    require_columns(bars, needed, "features")
    step = micros(bar_size)
    reach = max(f.lookback for f in features)
    stages = ordered_steps(features)
    rows = bars.select(*needed).where(
        F.when(F.col("bar_size") == bar_size, True).otherwise(
            F.raise_error(F.concat(F.lit("unexpected bar_size "), F.col("bar_size")))
        )
    )

    def build(w: WindowSpec) -> Mapping[str, Column]:
        out: dict[str, Column] = {}
        ready: list[Column] = [F.col("available_at")]
        for f in features:
            value = f.value(w)
            if f.contiguous and f.lookback > 0:
                span = elapsed(F.col("bar_start"), F.lag("bar_start", f.lookback).over(w))
                value = F.when(span == f.lookback * step, value)
            out[f.name] = value
            frame = w.rowsBetween(-f.lookback, 0)
            slowest = F.unix_micros(F.max("available_at").over(frame)) + F.lit(f.latency_us)
            full = F.count("available_at").over(frame) == f.lookback + 1
            ready.append(F.when(full, F.timestamp_micros(slowest)))
        out["__ready"] = F.greatest(*ready)
        return out

    def stage(steps: Sequence[Step]) -> Callable[[WindowSpec], Mapping[str, Column]]:
        return lambda w: {step_column(x.name): x.value(w) for x in steps}

    bucket = time_bucket("bar_start", step * CHUNK_ROWS)
    done = rolling(
        rows,
        keys,
        ["bar_start"],
        bucket,
        reach,
        build,
        first=[stage(steps) for steps in stages],
        chunk_rows=chunk_rows,
    )
    lead = list(dict.fromkeys([*keys, *KEY]))
    return done.select(
        *lead, *[k for k in keep if k not in lead], *names, F.col("__ready").alias("available_at")
    )
