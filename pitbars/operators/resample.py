"""Bars from events, and coarser bars from bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import floor_time, shift
from pitbars.types import BAR_COLUMNS, format_micros, micros, require_columns


def time_then(at: str, tiebreak: str) -> Column:
    """``(at, tiebreak)`` as one DECIMAL, for any BIGINT tie-break.

    A struct would order the same way but has no fixed width, which turns the hash
    aggregate below into a sort aggregate.
    """
    wide = F.lit("20000000000000000000").cast("decimal(20,0)")
    major = F.unix_micros(at).cast("decimal(17,0)") * wide
    return (major + F.col(tiebreak).cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_events(
    events: DataFrame,
    *,
    instrument: str | Column,
    at: str,
    price: str,
    quantity: str,
    tiebreak: str,
    bar_size: str,
    latency: str | int = "2s",
    source: str = "events",
) -> DataFrame:
    """Open/high/low/close bars over half-open, epoch-aligned windows.

    One shuffle with map-side combining: every aggregate keeps a constant-size buffer.
    """
    inst = F.col(instrument) if isinstance(instrument, str) else instrument
    place = time_then(at, tiebreak)
    p, q = F.col(price), F.col(quantity)
    grouped = events.groupBy(
        inst.cast("string").alias("instrument_id"), floor_time(at, bar_size).alias("bar_start")
    ).agg(
        F.min_by(p, place).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, place).alias("close"),
        F.sum(q).cast("double").alias("volume"),
        F.try_divide(F.sum(p * q), F.sum(q)).alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    end = shift("bar_start", bar_size)
    return grouped.select(
        "instrument_id",
        F.lit(bar_size).alias("bar_size"),
        "bar_start",
        end.alias("bar_end"),
        shift(end, latency).alias("available_at"),
        *["open", "high", "low", "close", "volume", "vwap", "trade_count"],
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("source_key"),
        F.lit(0).alias("revision"),
        end.alias("ingested_at"),
    )


def latest_revisions(bars: DataFrame) -> DataFrame:
    """One row per ``(instrument, size, start)``: the highest revision present."""
    key = ["instrument_id", "bar_size", "bar_start"]
    rest = [c for c in bars.columns if c not in key]
    return (
        bars.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct("revision", "available_at")).alias("__row"))
        .select(*key, "__row.*")
        .select(*bars.columns)
    )


def resample(bars: DataFrame, *, source_size: str, target_size: str) -> DataFrame:
    """Aggregate bars to a whole multiple of their size.

    A coarse bar is available no earlier than its slowest input and no earlier than its own
    end, so an incomplete window never shows before it has closed. ``vwap`` weighs only
    inputs that carry one and is null when none does.
    """
    require_columns(bars, BAR_COLUMNS, "resample")
    fine, coarse = micros(source_size), micros(target_size)
    if coarse <= fine or coarse % fine:
        raise ValueError(f"{target_size} must be a larger whole multiple of {source_size}")
    checked = bars.withColumn(
        "__ok",
        F.when(F.col("bar_size") == source_size, True).otherwise(
            F.raise_error(F.concat(F.lit("unexpected bar_size "), F.col("bar_size")))
        ),
    ).where("__ok")
    place = F.struct("bar_start", "revision")
    priced = F.col("vwap").isNotNull()
    grouped = checked.groupBy(
        "instrument_id", floor_time("bar_start", coarse).alias("__start")
    ).agg(
        F.min_by("open", place).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", place).alias("close"),
        F.sum("volume").alias("volume"),
        F.try_divide(
            F.sum(F.col("vwap") * F.col("volume")), F.sum(F.when(priced, F.col("volume")))
        ).alias("vwap"),
        F.sum("trade_count").alias("trade_count"),
        F.max("available_at").alias("__inputs"),
        F.min_by("source", place).alias("source"),
        F.max("revision").alias("revision"),
        F.max("ingested_at").alias("ingested_at"),
    )
    end = shift("__start", coarse)
    return grouped.select(
        "instrument_id",
        F.lit(format_micros(coarse)).alias("bar_size"),
        F.col("__start").alias("bar_start"),
        end.alias("bar_end"),
        F.greatest("__inputs", end).alias("available_at"),
        *["open", "high", "low", "close", "volume", "vwap", "trade_count", "source"],
        F.lit(None).cast("string").alias("source_key"),
        "revision",
        "ingested_at",
    )


def periodic_equity(curve: DataFrame, *, keys, bar_size: str) -> DataFrame:
    """Last snapshot of each epoch-aligned interval per key."""
    held = [c for c in curve.columns if c not in keys and c != "at"]
    return (
        curve.groupBy(*keys, floor_time("at", bar_size).alias("period"))
        .agg(F.max_by(F.struct(*held), F.col("at")).alias("__s"))
        .select(*keys, "period", "__s.*")
    )
