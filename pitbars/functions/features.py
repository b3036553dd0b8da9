"""Causal rolling features as Column builders.

A feature declares how many rows it reaches back and builds its value over an ordered
window. :func:`pitbars.operators.features.compute_features` adds the contiguity gate and the
availability of the whole row, so a user feature is only the expression itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from pitbars.functions.scalars import elapsed
from pitbars.types import MINUTE


@dataclass(frozen=True)
class Step:
    """A column that is worked out before features are, since windows do not nest.

    ``value`` builds it over the same ordered window and may read the columns of the steps
    that ``uses`` names. Features that name equal steps share one column, so the name has to
    say everything that decides the value.
    """

    name: str
    value: Callable[[WindowSpec], Column] = field(compare=False)
    uses: tuple[str, ...] = ()


def step_column(name: str) -> str:
    return f"__step_{name}"


def ordered_steps(features: Sequence[FeatureSpec]) -> list[list[Step]]:
    """The steps of all features, each once, in stages that only use earlier ones."""
    steps: dict[str, Step] = {}
    for f in features:
        for step in f.steps:
            if steps.setdefault(step.name, step) != step:
                raise ValueError(f"features disagree on the step {step.name}")
    unknown = sorted({u for s in steps.values() for u in s.uses} - set(steps))
    if unknown:
        raise ValueError(f"steps use {unknown}, which no feature declares")
    stages: list[list[Step]] = []
    placed: set[str] = set()
    while len(placed) < len(steps):
        ready = [s for s in steps.values() if s.name not in placed and placed.issuperset(s.uses)]
        if not ready:
            raise ValueError(f"steps use each other: {sorted(set(steps) - placed)}")
        stages.append(ready)
        placed |= {s.name for s in ready}
    return stages


@dataclass(frozen=True)
class FeatureSpec:
    """Name, inputs, reach, and the value over an ordered per-instrument window.

    ``lookback`` counts all rows back that the value depends on, those of its steps included.
    """

    name: str
    inputs: tuple[str, ...]
    lookback: int
    value: Callable[[WindowSpec], Column] = field(compare=False)
    contiguous: bool = True
    latency_us: int = 0
    kind: str = ""
    params: tuple[tuple[str, object], ...] = ()
    steps: tuple[Step, ...] = ()

    def __post_init__(self) -> None:
        if self.lookback < 0 or self.latency_us < 0:
            raise ValueError(f"feature {self.name}: lookback and latency cannot be negative")

    def describe(self) -> str:
        """Stable text of everything that decides the values; hashed for the sidecar."""
        parts = [self.kind, self.name, str(self.inputs), str(self.lookback)]
        return "|".join([*parts, str(self.contiguous), str(self.latency_us), str(self.params)])


def _full(column: str | Column, agg: Column, w: WindowSpec, rows: int, last: int = 0) -> Column:
    """``agg`` over a row frame, null unless the frame holds ``rows`` non-null values."""
    frame = w.rowsBetween(last - rows + 1, last)
    return F.when(F.count(column).over(frame) >= rows, agg.over(frame))


def _step_return(w: WindowSpec, kind: str, lag: int = 1) -> Column:
    ratio = F.try_divide(F.col("close"), F.lag("close", lag).over(w))
    if kind not in ("simple", "log"):
        raise ValueError(f"unknown return kind {kind!r}")
    return F.ln(ratio) if kind == "log" else ratio - 1


def lagged_return(lag: int = 1, kind: str = "simple", contiguous: bool = True) -> FeatureSpec:
    if lag < 1:
        raise ValueError("lag must be at least 1")
    name = f"ret_{lag}" if kind == "simple" else f"ret_{kind}_{lag}"
    return FeatureSpec(
        name, ("close",), lag, lambda w: _step_return(w, kind, lag), contiguous,
        kind="lagged_return", params=(("lag", lag), ("kind", kind)),
    )


def rolling_volatility(
    window: int = 20, kind: str = "simple", contiguous: bool = True
) -> FeatureSpec:
    """Sample deviation of the last ``window`` one-bar returns."""
    if window < 2:
        raise ValueError("window must be at least 2")
    name = f"vol_{window}" if kind == "simple" else f"vol_{kind}_{window}"
    returns = step_column(f"return_{kind}")
    return FeatureSpec(
        name, ("close",), window,
        lambda w: _full(returns, F.stddev_samp(returns), w, window), contiguous,
        kind="rolling_volatility", params=(("window", window), ("kind", kind)),
        steps=(Step(f"return_{kind}", lambda w: _step_return(w, kind)),),
    )


def relative_volume(window: int = 20, contiguous: bool = True) -> FeatureSpec:
    """Volume over the mean of the previous ``window`` bars; null when that mean is not positive."""
    if window < 1:
        raise ValueError("window must be at least 1")

    def value(w: WindowSpec) -> Column:
        mean = _full("volume", F.avg("volume"), w, window, last=-1)
        return F.when(mean > 0, F.try_divide(F.col("volume"), mean))

    return FeatureSpec(
        f"rvol_{window}", ("volume",), window, value, contiguous,
        kind="relative_volume", params=(("window", window),),
    )


def rolling_zscore(window: int = 20, column: str = "close", contiguous: bool = True) -> FeatureSpec:
    """Distance from the window mean in sample deviations; null on a flat window.

    Flatness is read from min and max, which are exact, and not only from the deviation,
    whose rounding can leave a tiny positive value.
    """
    if window < 2:
        raise ValueError("window must be at least 2")

    def value(w: WindowSpec) -> Column:
        frame = w.rowsBetween(1 - window, 0)
        moving = F.max(column).over(frame) > F.min(column).over(frame)
        mean = _full(column, F.avg(column), w, window)
        std = _full(column, F.stddev_samp(column), w, window)
        return F.when(moving & (std > 0), F.try_divide(F.col(column) - mean, std))

    name = f"zscore_{window}" if column == "close" else f"zscore_{column}_{window}"
    return FeatureSpec(
        name, (column,), window - 1, value, contiguous,
        kind="rolling_zscore", params=(("window", window), ("column", column)),
    )


def rolling_range(window: int = 20, contiguous: bool = True) -> FeatureSpec:
    if window < 1:
        raise ValueError("window must be at least 1")

    def value(w: WindowSpec) -> Column:
        high = _full("high", F.max("high"), w, window)
        low = _full("low", F.min("low"), w, window)
        return F.when(F.col("close") > 0, (high - low) / F.col("close"))

    return FeatureSpec(
        f"range_{window}", ("high", "low", "close"), window - 1, value, contiguous,
        kind="rolling_range", params=(("window", window),),
    )


def _scalar(name: str, inputs: tuple[str, ...], expr: Callable[[], Column], **params) -> FeatureSpec:
    return FeatureSpec(
        name, inputs, 0, lambda w: expr(), contiguous=False,
        kind=name, params=tuple(params.items()),
    )


def bar_range() -> FeatureSpec:
    return _scalar(
        "bar_range", ("high", "low", "close"),
        lambda: F.try_divide(F.col("high") - F.col("low"), F.col("close")),
    )


def minute_of_day(encoding: str = "raw") -> FeatureSpec:
    if encoding not in ("raw", "sin", "cos"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def expr() -> Column:
        minute = F.hour("bar_start") * 60 + F.minute("bar_start")
        if encoding == "raw":
            return minute
        turn = minute * F.lit(2 * math.pi / 1440)
        return F.sin(turn) if encoding == "sin" else F.cos(turn)

    suffix = "" if encoding == "raw" else f"_{encoding}"
    return _scalar(f"minute_of_day_utc{suffix}", ("bar_start",), expr, encoding=encoding)


def day_of_week() -> FeatureSpec:
    return _scalar("day_of_week_utc", ("bar_start",), lambda: F.weekday("bar_start"))


def minutes_since_open() -> FeatureSpec:
    return _scalar(
        "minutes_since_open", ("bar_start", "session_open"),
        lambda: F.floor(elapsed("bar_start", "session_open") / MINUTE).cast("int"),
    )


def minutes_to_close() -> FeatureSpec:
    return _scalar(
        "minutes_to_close", ("bar_end", "session_close"),
        lambda: F.floor(elapsed("session_close", "bar_end") / MINUTE).cast("int"),
    )


def session_fraction() -> FeatureSpec:
    return _scalar(
        "session_fraction", ("bar_start", "session_open", "session_close"),
        lambda: F.try_divide(
            elapsed("bar_start", "session_open"), elapsed("session_close", "session_open")
        ),
    )


def is_early_close(regular_minutes: int = 390) -> FeatureSpec:
    return _scalar(
        "is_early_close", ("session_open", "session_close"),
        lambda: (elapsed("session_close", "session_open") < regular_minutes * MINUTE).cast("int"),
        regular_minutes=regular_minutes,
    )


FEATURES: dict[str, Callable[..., FeatureSpec]] = {
    "lagged_return": lagged_return,
    "rolling_volatility": rolling_volatility,
    "relative_volume": relative_volume,
    "rolling_zscore": rolling_zscore,
    "rolling_range": rolling_range,
    "bar_range": bar_range,
    "minute_of_day": minute_of_day,
    "day_of_week": day_of_week,
    "minutes_since_open": minutes_since_open,
    "minutes_to_close": minutes_to_close,
    "session_fraction": session_fraction,
    "is_early_close": is_early_close,
}


def build_feature(kind: str, **params) -> FeatureSpec:
    """A feature by registered name with typed parameters."""
    if kind not in FEATURES:
        raise KeyError(f"unknown feature {kind!r}; known: {sorted(FEATURES)}")
    return FEATURES[kind](**params)


def register_feature(kind: str, factory: Callable[..., FeatureSpec]) -> None:
    if kind in FEATURES:
        raise ValueError(f"feature {kind!r} is already registered")
    FEATURES[kind] = factory
