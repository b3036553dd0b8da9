"""Structured Streaming forms: bars from events, late rows, natural-key dedup, running findings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pitbars.functions.scalars import shift
from pitbars.operators.quality import row_findings
from pitbars.operators.resample import time_then
from pitbars.types import NATURAL_KEY, micros


def interval_text(duration: str | int) -> str:
    return f"{micros(duration)} microseconds"


def stream_bars(
    events: DataFrame, *, instrument: str | Column, at: str, price: str, quantity: str,
    tiebreak: str, bar_size: str, latency: str | int,
) -> DataFrame:
    """Bars from an event stream; run it in append mode.

    The watermark trails by the publication latency, so a bar appears only after its window
    has ended and its late arrivals are in. Events later than that are dropped;
    :func:`late_rows_sink` in front of it keeps and counts them. ``at`` must be ``TIMESTAMP``; a watermark
    needs a zoned time.
    """
    if dict(events.dtypes)[at] != "timestamp":
        raise ValueError(f"{at} must be TIMESTAMP to carry a watermark")
    inst = F.col(instrument) if isinstance(instrument, str) else instrument
    place, p, q = time_then(at, tiebreak), F.col(price), F.col(quantity)
    bars = (
        events.withWatermark(at, interval_text(latency))
        .groupBy(inst.cast("string").alias("instrument_id"), F.window(at, interval_text(bar_size)))
        .agg(
            F.min_by(p, place).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, place).alias("close"),
            F.sum(q).cast("double").alias("volume"),
            F.try_divide(F.sum(p * q), F.sum(q)).alias("vwap"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )
    return bars.select(
        "instrument_id",
        F.lit(bar_size).alias("bar_size"),
        F.col("window.start").alias("bar_start"),
        F.col("window.end").alias("bar_end"),
        shift(F.col("window.end"), latency).alias("available_at"),
        *["open", "high", "low", "close", "volume", "vwap", "trade_count"],
        F.lit(0).alias("revision"),
    )


def stream_deduplicated(bars: DataFrame, *, delay: str | int, at: str = "bar_start") -> DataFrame:
    """First arrival of each natural key within the watermark delay."""
    return bars.withWatermark(at, interval_text(delay)).dropDuplicatesWithinWatermark(NATURAL_KEY)


def findings_sink(path: str, latency: str | int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each micro-batch's findings.

    A batch owns one folder named by its number, so a replay after a failure overwrites
    its own rows and nothing is counted twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        row_findings(batch, latency).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return store


def late_rows_sink(
    path: str, *, at: str, bar_size: str | int, latency: str | int
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that parts a micro-batch into rows in time and late ones.

    A row is late when its window had ended by the watermark of :func:`stream_bars`, which is
    the latest time of all earlier batches less ``latency``; it would be dropped there. Rows
    go to ``<path>/kept`` or ``<path>/late``, so nothing is lost and late rows can be counted
    or merged as a revision. Every batch owns one folder in each, named by its number, and
    notes its latest time in ``<path>/seen``; a replay reads the notes of earlier batches only
    and writes the same rows again.
    """
    size, delay = micros(bar_size), micros(latency)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        notes = "batch BIGINT, us BIGINT"
        latest = None
        if number:
            seen = spark.read.schema(notes).parquet(*[f"{path}/seen/batch={n}" for n in range(number)])
            latest = seen.agg(F.max("us")).first()[0]
        us = F.unix_micros(at)
        ended = us - F.pmod(us, F.lit(size)) + size
        late = F.lit(False) if latest is None else F.coalesce(ended <= latest - delay, F.lit(False))
        marked = batch.withColumn("__late", late)
        for name, mine in (("late", F.col("__late")), ("kept", ~F.col("__late"))):
            marked.where(mine).drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        note = batch.agg(F.lit(number).cast("bigint").alias("batch"), F.max(us).alias("us"))
        note.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return store


_WAITING = "starts ARRAY<BIGINT>, revisions ARRAY<INT>, ready ARRAY<BIGINT>, last_ready BIGINT, last_start BIGINT"


def stream_out_of_order(bars: DataFrame, *, delay: str | int, forget: str | int) -> DataFrame:
    """Bars that became available before the bar of their instrument that precedes them.

    Bars may arrive in any order within ``delay``. The state of an instrument holds the bars
    the watermark has not passed yet, and the availability of the last one it has; a bar is
    compared once no earlier one can come. State of an instrument that has been silent for
    ``forget`` beyond its last bar goes. Yields ``instrument_id, bar_start, revision,
    available_at, previous_available_at``; run it in append mode.
    """
    gap = micros(forget) // 1000

    def run(key, frames, state):
        if state.exists:
            starts, revisions, ready, last, newest = (list(x) if isinstance(x, (list, np.ndarray)) else x for x in state.get)
        else:
            starts, revisions, ready, last, newest = [], [], [], None, None
        for frame in frames:
            starts += frame["start_us"].tolist()
            revisions += frame["revision"].tolist()
            ready += frame["ready_us"].tolist()
        mark = state.getCurrentWatermarkMs()
        order = sorted(range(len(starts)), key=lambda i: (starts[i], revisions[i]))
        passed = [i for i in order if starts[i] // 1000 <= mark]
        found = []
        for i in passed:
            if last is not None and ready[i] < last:
                found.append((key[0], starts[i], revisions[i], ready[i], last))
            last, newest = ready[i], starts[i]
        kept = order[len(passed):]
        if not kept and newest is not None and state.hasTimedOut and newest // 1000 + gap <= mark:
            state.remove()
        else:
            state.update(([starts[i] for i in kept], [revisions[i] for i in kept], [ready[i] for i in kept], last, newest))
            due = starts[kept[0]] // 1000 if kept else newest // 1000 + gap
            state.setTimeoutTimestamp(max(due, mark + 1))
        yield pd.DataFrame(found, columns=["instrument_id", "start_us", "revision", "ready_us", "last_us"])

    slim = bars.withWatermark("bar_start", interval_text(delay)).select(
        "instrument_id", "bar_start", F.unix_micros("bar_start").alias("start_us"), "revision",
        F.unix_micros("available_at").alias("ready_us"),
    )
    out = slim.groupBy("instrument_id").applyInPandasWithState(
        run, "instrument_id STRING, start_us BIGINT, revision INT, ready_us BIGINT, last_us BIGINT",
        _WAITING, "append", GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(
        "instrument_id", F.timestamp_micros("start_us").alias("bar_start"), "revision",
        F.timestamp_micros("ready_us").alias("available_at"),
        F.timestamp_micros("last_us").alias("previous_available_at"),
    )
