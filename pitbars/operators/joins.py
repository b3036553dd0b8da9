"""As-of, interval, and position joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import bucket_of, elapsed, overlaps, time_bucket
from pitbars.operators.ordered import by_key_size, running
from pitbars.types import DAY, micros, require_columns


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: Column,
    right_on: Column,
    by: Sequence[str],
    tiebreak: Sequence[str],
    forward: bool = False,
    width: int = DAY,
    name: str = "match",
    short_keys: bool = False,
) -> DataFrame:
    """Left rows plus one struct column holding the nearest right row (or null).

    Backward: the latest right row at or before the left instant. Forward: the earliest at
    or after it. Equal instants match. Among right rows with equal instants the greatest by
    ``tiebreak`` wins backward, the least forward. Both sides are stacked and scanned once
    per ``(key, time bucket)``; rows from earlier buckets arrive as carry-in. With
    ``short_keys`` only large keys are cut into buckets.
    """
    sign = -1 if forward else 1
    keys = [f"__k{i}" for i in range(len(by))]
    ties = [f"__t{i}" for i in range(len(tiebreak))]
    left_rows = left.select(
        *[F.col(k).alias(a) for k, a in zip(by, keys)],
        (F.lit(sign) * F.unix_micros(left_on)).alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*left.columns).alias("__left"),
    )
    right_rows = right.select(
        *[F.col(k).alias(a) for k, a in zip(by, keys)],
        (F.lit(sign) * F.unix_micros(right_on)).alias("__at"),
        F.lit(0).alias("__side"),
        *[F.col(t).alias(a) for t, a in zip(tiebreak, ties)],
        F.struct(*right.columns).alias("__right"),
    ).where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "__at"]))
    stacked = left_rows.unionByName(right_rows, allowMissingColumns=True)
    if forward:  # scanning in reverse: the last row met must be the least by tiebreak
        ties_first = [f"__r{i}" for i in range(len(ties))]
        stacked = _reverse_ties(stacked, ties, ties_first)
        ties = ties_first

    def scan(rows: DataFrame, split: bool) -> DataFrame:
        bucket = bucket_of(F.col("__at"), width) if split else None
        return running(rows, keys, ["__at", "__side", *ties], bucket, lasts={"__found": F.col("__right")})

    scanned = by_key_size(stacked, keys, scan) if short_keys else scan(stacked, True)
    return scanned.where(F.col("__side") == 1).select(
        "__left.*", F.when(F.col("__at").isNotNull(), F.col("__found")).alias(name)
    )


def _reverse_ties(df: DataFrame, ties: Sequence[str], names: Sequence[str]) -> DataFrame:
    out = df
    for tie, name in zip(ties, names):
        kind = dict(df.dtypes)[tie]
        if kind in ("timestamp", "timestamp_ntz"):
            value = -F.unix_micros(F.col(tie).cast("timestamp"))
        elif kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or (
            kind.startswith("decimal")
        ):
            value = -F.col(tie)
        else:
            raise TypeError(f"a forward match needs numeric or time tie-breaks, not {kind}")
        out = out.withColumn(name, value)
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    as_of: str,
    by: Sequence[str] = ("instrument_id",),
    prefix: str = "",
    max_staleness=None,
    tiebreak: Sequence[str] | None = None,
    width: int = DAY,
) -> DataFrame:
    """Attach the latest right observation available at each left cutoff.

    The right side is matched on ``available_at`` only, equality included. A match older
    than ``max_staleness`` counts as none. Equal availabilities are settled by
    ``tiebreak`` (default: every plain payload column, in order), so the result does not
    depend on row order.
    """
    require_columns(right, ["available_at", *by], "as-of join, right side")
    require_columns(left, [as_of, *by], "as-of join, left side")
    payload = [c for c in right.columns if c not in by and c != "available_at"]
    attached = {c: f"{prefix}{c}" for c in ["available_at", *payload]}
    clash = sorted(set(attached.values()) & set(left.columns))
    if clash:
        raise ValueError(f"right columns {clash} collide with the left side; pass a prefix")
    if tiebreak is None:
        plain = ("map", "array", "struct")
        tiebreak = [c for c, t in right.dtypes if c in payload and not t.startswith(plain)]
    found = nearest(
        left,
        right,
        left_on=F.col(as_of),
        right_on=F.col("available_at"),
        by=by,
        tiebreak=tiebreak,
        width=width,
        name="__match",
    )
    usable = F.col("__match").isNotNull()
    if max_staleness is not None:
        age = elapsed(F.col(as_of), F.col("__match.available_at"))
        usable = usable & (age <= micros(max_staleness))
    return found.select(
        *left.columns,
        *[F.when(usable, F.col("__match")[c]).alias(a) for c, a in attached.items()],
    )


def late_matches(joined: DataFrame, *, as_of: str, attached: str = "available_at") -> DataFrame:
    """Rows of an as-of result that break the promise; empty for a sound join."""
    return joined.where(F.col(attached) > F.col(as_of))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    at: str,
    start: str = "start",
    end: str = "end",
    by: Sequence[str] = (),
    how: str = "inner",
    width: str | int = DAY,
) -> DataFrame:
    """Points with the half-open intervals that hold them.

    Intervals are listed under every time bucket they touch, so the join is an equi-join on
    ``(by, bucket)`` with a range condition; Spark broadcasts the interval side when its
    measured size is under the session's threshold.
    """
    if how not in ("inner", "left"):
        raise ValueError("interval_join supports inner and left")
    w = micros(width)
    listed = intervals.where(F.col(start) < F.col(end)).withColumn(
        "__b",
        F.explode(F.sequence(time_bucket(start, w), bucket_of(F.unix_micros(end) - 1, w))),
    )
    right = listed.select(
        *[F.col(k).alias(f"__k_{k}") for k in by],
        "__b",
        F.col(start).alias("__from"),
        F.col(end).alias("__upto"),
        *[F.col(c) for c in intervals.columns if c not in by],
    )
    left = points.withColumn("__pb", time_bucket(at, w))
    cond = (F.col("__pb") == F.col("__b")) & (F.col(at) >= F.col("__from"))
    cond = cond & (F.col(at) < F.col("__upto"))
    for k in by:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    joined = left.join(right, cond, how)
    return joined.drop("__pb", "__b", "__upto", "__from", *[f"__k_{k}" for k in by])


def overlap_join(
    left: DataFrame, right: DataFrame, *, condition: Column | None = None, by: Sequence[str] = (),
    left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("start", "end"),
    width: str | int = DAY,
) -> DataFrame:
    """Pairs of half-open ranges that share an instant, each pair once.

    Both sides are listed under every time bucket they touch and meet by an equi-join on
    ``(by, bucket)``; a pair is reported only in the first bucket both have, the later of
    their first ones. Right columns get the prefix ``right_``, key columns excepted.
    ``condition`` narrows the pairs and may name columns of both sides. Empty ranges overlap
    with nothing.
    """
    w = micros(width)

    def listed(df: DataFrame, span: tuple[str, str], bucket: str, first: str) -> DataFrame:
        start, end = span
        begun = time_bucket(start, w)
        return df.where(F.col(start) < F.col(end)).withColumns(
            {first: begun, bucket: F.explode(F.sequence(begun, bucket_of(F.unix_micros(end) - 1, w)))}
        )

    names = {c: f"right_{c}" for c in right.columns if c not in by}
    a = listed(left, left_range, "__bucket", "__first_a")
    renamed = right.withColumnsRenamed(names)
    b = listed(renamed, (names[right_range[0]], names[right_range[1]]), "__bucket", "__first_b")
    met = a.join(b, [*by, "__bucket"]).where(F.col("__bucket") == F.greatest("__first_a", "__first_b"))
    met = met.where(overlaps(
        F.col(left_range[0]), F.col(left_range[1]), F.col(names[right_range[0]]), F.col(names[right_range[1]])
    ))
    if condition is not None:
        met = met.where(condition)
    return met.select(*left.columns, *names.values())


def outside_ranges(
    points: DataFrame, ranges: DataFrame, *, at: str, start: str = "start", end: str = "end",
    width: str | int = DAY,
) -> DataFrame:
    """Points that no half-open range holds, by an anti-join on the time bucket."""
    w = micros(width)
    listed = ranges.where(F.col(start) < F.col(end)).select(
        F.explode(F.sequence(time_bucket(start, w), bucket_of(F.unix_micros(end) - 1, w))).alias("__b"),
        F.col(start).alias("__from"), F.col(end).alias("__upto"),
    )
    held = (F.col("__pb") == F.col("__b")) & (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__upto"))
    return points.withColumn("__pb", time_bucket(at, w)).join(listed, held, "left_anti").drop("__pb")


def first_open_after(
    rows: DataFrame, opens: DataFrame, *, at: str, by=("instrument_id",), name: str = "next_open"
) -> DataFrame:
    """Forward lookup: the earliest open at or after ``at`` as a struct, or null."""
    return nearest(
        rows,
        opens,
        left_on=F.col(at),
        right_on=F.col("bar_start"),
        by=by,
        tiebreak=["bar_start"],
        forward=True,
        name=name,
    )


def containing_bar(
    rows: DataFrame,
    opens: DataFrame,
    *,
    at: str,
    step: str | int,
    by=("instrument_id",),
    name: str = "containing",
) -> DataFrame:
    """The bar whose interval holds ``at`` as a struct, or null when there is none."""
    found = nearest(
        rows,
        opens,
        left_on=F.col(at),
        right_on=F.col("bar_start"),
        by=by,
        tiebreak=["bar_start"],
        name="__bar",
    )
    inside = elapsed(F.col(at), F.col("__bar.bar_start")) < micros(step)
    return found.withColumn(name, F.when(inside, F.col("__bar"))).drop("__bar")
