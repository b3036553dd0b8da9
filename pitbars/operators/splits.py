"""Walk-forward folds, roles, exclusions, and sealed windows as small tables.

Fold tables are computed from the data's own span by column arithmetic; they are metadata
(one row per fold and role) and join to rows as intervals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitbars.functions.scalars import instant, shift
from pitbars.operators.joins import interval_join, outside_ranges, overlap_join
from pitbars.types import micros, require_columns, utc

FITTABLE = ("train",)


@dataclass(frozen=True)
class WalkForward:
    """Lengths of the parts of a fold; every length is a duration or microseconds."""

    train: str | int
    test: str | int
    validation: str | int = 0
    step: str | int | None = None
    warmup: str | int = 0
    purge: str | int = 0
    label_horizon: str | int | None = None
    embargo: str | int = 0
    expanding: bool = False

    def __post_init__(self) -> None:
        for name in ("train", "test"):
            if micros(getattr(self, name)) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.step is not None and micros(self.step) <= 0:
            raise ValueError("step must be positive")
        if micros(self.purge) == 0 and self.label_horizon is None:
            raise ValueError("state the gap: give purge or label_horizon (zero is a choice)")

    @property
    def gap(self) -> int:
        """The effective purge: never shorter than the longest label horizon."""
        return max(micros(self.purge), micros(self.label_horizon or 0))

    @property
    def advance(self) -> int:
        if self.step is not None:
            return micros(self.step)
        return micros(self.validation) + micros(self.test)

    def offsets(self) -> list[tuple[str, int, int]]:
        """``(role, start, end)`` relative to the end of training, in time order."""
        parts, cursor = [], 0
        lengths = [("purge", self.gap)]
        if micros(self.validation):
            lengths += [("validation", micros(self.validation)), ("purge", self.gap)]
        lengths += [("test", micros(self.test)), ("embargo", micros(self.embargo))]
        for role, length in lengths:
            if length:
                parts.append((role, cursor, cursor + length))
                cursor += length
        return parts


def ranges(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A literal ``name, start, end`` table of aware instants."""
    values = [(n, utc(a), utc(b)) for n, a, b in rows]
    if any(a >= b for _, a, b in values):
        raise ValueError("ranges are half-open and must not be empty")
    return spark.createDataFrame(values, "name STRING, start TIMESTAMP, end TIMESTAMP")


def span_of(rows: DataFrame, *, start: str = "bar_start", end: str = "bar_end") -> DataFrame:
    return rows.agg(F.min(start).alias("start"), F.max(end).alias("end"))


def walk_forward(span: DataFrame, plan: WalkForward, exclude: DataFrame | None = None) -> DataFrame:
    """``fold, role, start, end`` for every fold whose test range ends inside the span.

    A fold whose reach (warm-up to test end) touches an excluded range is left out, and the
    rest are numbered from zero.
    """
    warm, train = micros(plan.warmup), micros(plan.train)
    parts = plan.offsets()
    test_end = next(e for role, _, e in parts if role == "test")
    first_end = F.unix_micros("start") + F.lit(warm + train)
    count = F.floor((F.unix_micros("end") - first_end - F.lit(test_end)) / plan.advance).cast("bigint")
    folds = (
        span.select("start", "end", first_end.alias("__e0"), count.alias("__last"))
        .where(F.col("__last") >= 0)
        .select("__e0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))).alias("k"))
        .withColumn("train_end", F.col("__e0") + F.col("k") * plan.advance)
        .withColumn(
            "train_start",
            (F.col("__e0") if plan.expanding else F.col("train_end")) - F.lit(train),
        )
        .withColumns(
            {
                "reach_start": F.timestamp_micros(F.col("train_start") - F.lit(warm)),
                "reach_end": F.timestamp_micros(F.col("train_end") + F.lit(test_end)),
            }
        )
    )
    if exclude is not None:
        touched = overlap_join(folds, exclude, left_range=("reach_start", "reach_end")).select("k").distinct()
        folds = folds.join(touched, "k", "left_anti")
    # Metadata: one row per fold, so one task numbers them.
    folds = folds.withColumn(
        "fold", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1).cast("int")
    )
    rows = [("train", F.col("train_start"), F.col("train_end"))]
    if warm:
        rows.append(("warmup", F.col("train_start") - F.lit(warm), F.col("train_start")))
    rows += [
        (role, F.col("train_end") + F.lit(a), F.col("train_end") + F.lit(b)) for role, a, b in parts
    ]
    listed = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.timestamp_micros(a).alias("start"),
                F.timestamp_micros(b).alias("end"),
            )
            for role, a, b in rows
        ]
    )
    return folds.select("fold", F.inline(listed))


def require_folds(folds: DataFrame) -> DataFrame:
    """Raise when no fold fits; otherwise hand the table back."""
    if folds.isEmpty():
        raise ValueError("no fold fits the span (or all touch an excluded range)")
    return folds


def fixed_split(
    spark: SparkSession,
    *,
    train: tuple,
    test: tuple,
    validation: tuple | None = None,
    warmup: str | int = 0,
    purge: str | int = 0,
    label_horizon: str | int = 0,
) -> DataFrame:
    """One explicit fold; gaps between the parts must be at least the purge."""
    gap = dt.timedelta(microseconds=max(micros(purge), micros(label_horizon)))
    parts = [("train", *map(utc, train))]
    if validation:
        parts.append(("validation", *map(utc, validation)))
    parts.append(("test", *map(utc, test)))
    rows = []
    if micros(warmup):
        begin = parts[0][1]
        rows.append((0, "warmup", begin - dt.timedelta(microseconds=micros(warmup)), begin))
    for (_, _, left_end), (role, right_start, _) in zip(parts, parts[1:]):
        if right_start - left_end < gap:
            raise ValueError(f"the gap before {role} is shorter than the purge")
        if right_start > left_end:
            rows.append((0, "purge", left_end, right_start))
    rows += [(0, role, a, b) for role, a, b in parts]
    return spark.createDataFrame(rows, "fold INT, role STRING, start TIMESTAMP, end TIMESTAMP")


def train_exclusions(folds: DataFrame) -> DataFrame:
    """Embargoes of earlier folds that reach into a later fold's training range."""
    embargo = folds.where("role = 'embargo'").select("fold", "start", "end")
    train = folds.where("role = 'train'").select("fold", "start", "end")
    met = overlap_join(train, embargo, condition=F.col("right_fold") < F.col("fold"))
    return met.select(
        "fold", F.col("right_fold").alias("from_fold"), F.col("right_start").alias("start"),
        F.col("right_end").alias("end"),
    )


def overlapping_roles(folds: DataFrame) -> DataFrame:
    """Pairs of roles of one fold that share an instant; empty for a sound table."""
    w = Window.partitionBy("fold").orderBy("start", "end")
    nxt = folds.withColumns({"next_role": F.lead("role").over(w), "next_start": F.lead("start").over(w)})
    return nxt.where(F.col("next_start") < F.col("end")).select("fold", "role", "next_role")


def assign_roles(rows: DataFrame, folds: DataFrame, *, on: str = "available_at") -> DataFrame:
    """Tag rows with ``fold`` and ``split_role``; one output row per fold that holds a row."""
    require_columns(rows, [on], "assign_roles")
    table = folds.select("fold", F.col("role").alias("split_role"), "start", "end")
    return interval_join(rows, table, at=on).drop("start", "end")


def select_role(tagged: DataFrame, role: str) -> DataFrame:
    return tagged.where(F.col("split_role") == role)


def training_rows(rows: DataFrame, folds: DataFrame, *, on: str = "available_at") -> DataFrame:
    """Rows a fit may see per fold: inside train, outside earlier embargoes."""
    table = folds.where("role = 'train'").select("fold", "start", "end")
    inside = interval_join(rows, table, at=on).drop("start", "end")
    banned = train_exclusions(folds).select(
        F.col("fold").alias("x_fold"), F.col("start").alias("x_start"), F.col("end").alias("x_end")
    )
    hit = (F.col("fold") == F.col("x_fold")) & (F.col(on) >= F.col("x_start")) & (
        F.col(on) < F.col("x_end")
    )
    return inside.join(banned, hit, "left_anti").withColumn("split_role", F.lit("train"))


def guarded(windows: DataFrame) -> DataFrame:
    """Sealed windows widened by their gap (``gap_us``) on both sides."""
    return windows.select(
        "name",
        F.timestamp_micros(F.unix_micros("start") - F.col("gap_us")).alias("start"),
        F.timestamp_micros(F.unix_micros("end") + F.col("gap_us")).alias("end"),
    )


def sealed_windows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """``(name, start, end, gap)`` rows as a table; names are unique."""
    names = [r[0] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError(f"sealed window names repeat: {names}")
    values = [(n, utc(a), utc(b), micros(g)) for n, a, b, g in rows]
    return spark.createDataFrame(values, "name STRING, start TIMESTAMP, end TIMESTAMP, gap_us BIGINT")


def outside(ranges_rows: Sequence[tuple], on: str = "bar_start") -> Column:
    """Predicate: not inside any ``(start, end, gap)`` range."""
    ok = F.lit(True)
    for start, end, gap in ranges_rows:
        lo = shift(instant(start), gap, -1)
        hi = shift(instant(end), gap)
        ok = ok & ~((F.col(on) >= lo) & (F.col(on) < hi))
    return ok


def development_rows(rows: DataFrame, windows: DataFrame, *, on: str = "bar_start") -> DataFrame:
    """Rows outside every sealed window and its gaps."""
    return outside_ranges(rows, guarded(windows), at=on)


def touching_folds(folds: DataFrame, windows: DataFrame) -> DataFrame:
    """Folds whose reach overlaps a guarded window, with the window's name."""
    reach = folds.where("role != 'embargo'").groupBy("fold").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return overlap_join(reach, guarded(windows)).select("fold", F.col("right_name").alias("name"))


def check_sealed(folds: DataFrame, windows: DataFrame, *, unsealed: Sequence[str] = ()) -> None:
    """Refuse a fold table that touches a sealed window that was not opened by name."""
    hits = touching_folds(folds, windows).where(~F.col("name").isin(list(unsealed))).limit(5)
    found = hits.collect()
    if found:
        raise ValueError(f"folds touch sealed windows: {[(r['fold'], r['name']) for r in found]}")
