"""Trading sessions as tables, computed from date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import shift
from pitbars.types import DAY, HOUR, MINUTE

NEW_YORK = "America/New_York"

# Full-day exchange closures outside the holiday rules.
SPECIAL_CLOSURES = (
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
)
REGULAR_OPEN = 9 * HOUR + 30 * MINUTE
REGULAR_CLOSE = 16 * HOUR
EARLY_CLOSE = 13 * HOUR


def date_spine(rows: DataFrame, at: str, *, margin_days: int = 1) -> DataFrame:
    """Every date between the first and last ``at``, one row each."""
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return span.where(F.col("lo").isNotNull()).select(
        F.explode(
            F.sequence(
                F.date_sub(F.to_date("lo"), margin_days), F.date_add(F.to_date("hi"), margin_days)
            )
        ).alias("session_date")
    )


def always_open_sessions(dates: DataFrame) -> DataFrame:
    """UTC days as sessions."""
    start = F.col("session_date").cast("timestamp")
    return dates.select(
        "session_date",
        start.alias("session_open"),
        shift(start, DAY).alias("session_close"),
        F.lit(False).alias("early_close"),
    )


def _with_easter(dates: DataFrame) -> DataFrame:
    """Easter Sunday of each row's year, by Oudin's integer method."""
    return (
        dates.withColumn("__y", F.year("session_date"))
        .withColumns({"__c": F.expr("__y div 100"), "__n": F.expr("__y % 19")})
        .withColumn("__k", F.expr("(__c - 17) div 25"))
        .withColumn("__i", F.expr("(__c - __c div 4 - (__c - __k) div 3 + 19 * __n + 15) % 30"))
        .withColumn(
            "__i",
            F.expr(
                "__i - (__i div 28) * (1 - (__i div 28) * (29 div (__i + 1)) * ((21 - __n) div 11))"
            ),
        )
        .withColumn("__j", F.expr("(__y + __y div 4 + __i + 2 - __c + __c div 4) % 7"))
        .withColumn("__l", F.expr("__i - __j"))
        .withColumn("__m", F.expr("3 + (__l + 40) div 44"))
        .withColumn(
            "__easter",
            F.expr("make_date(__y, int(__m), int(__l + 28 - 31 * (__m div 4)))"),
        )
        .drop("__c", "__n", "__k", "__i", "__j", "__l", "__m")
    )


def _nth(month: int, day: str, n: int) -> Column:
    """The n-th named weekday of a month of ``__y``."""
    first = F.make_date(F.col("__y"), F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), day), 7 * (n - 1))


def _moved(month: int, day: int, *, saturday_back: bool = True) -> Column:
    """A fixed-date holiday as observed: Sunday to Monday, Saturday to Friday or not at all."""
    date = F.make_date(F.col("__y"), F.lit(month), F.lit(day))
    weekday = F.weekday(date)
    saturday = F.date_sub(date, 1) if saturday_back else F.lit(None).cast("date")
    return F.when(weekday == 6, F.date_add(date, 1)).when(weekday == 5, saturday).otherwise(date)


def xnys_sessions(dates: DataFrame) -> DataFrame:
    """Regular New York sessions for the given dates; holidays and weekends drop out."""
    day = F.col("session_date")
    thanksgiving = _nth(11, "Thu", 4)
    memorial = F.next_day(F.date_sub(F.make_date(F.col("__y"), F.lit(5), F.lit(31)), 7), "Mon")
    holidays = [
        _moved(1, 1, saturday_back=False),
        _nth(1, "Mon", 3),
        _nth(2, "Mon", 3),
        F.date_sub(F.col("__easter"), 2),
        memorial,
        F.when(F.col("__y") >= 2022, _moved(6, 19)),
        _moved(7, 4),
        _nth(9, "Mon", 1),
        thanksgiving,
        _moved(12, 25),
    ]
    closed = F.array_contains(F.array_compact(F.array(*holidays)), day)
    special = day.isin([F.lit(d).cast("date") for d in SPECIAL_CLOSURES])
    early = (
        (day == F.date_add(thanksgiving, 1))
        | ((F.month(day) == 12) & (F.dayofmonth(day) == 24))
        | ((F.month(day) == 7) & (F.dayofmonth(day) == 3) & (F.weekday(day) < 4))
    )
    midnight = day.cast("timestamp")
    open_at = F.to_utc_timestamp(shift(midnight, REGULAR_OPEN), NEW_YORK)
    close_at = F.to_utc_timestamp(
        F.when(early, shift(midnight, EARLY_CLOSE)).otherwise(shift(midnight, REGULAR_CLOSE)),
        NEW_YORK,
    )
    return (
        _with_easter(dates)
        .where((F.weekday(day) < 5) & ~closed & ~special)
        .select(
            "session_date",
            open_at.alias("session_open"),
            close_at.alias("session_close"),
            early.alias("early_close"),
        )
    )


CALENDARS = {
    "24x7:1": (always_open_sessions, "UTC"),
    "XNYS:1": (xnys_sessions, NEW_YORK),
}


def sessions_for(calendar_id: str, dates: DataFrame) -> DataFrame:
    if calendar_id not in CALENDARS:
        raise KeyError(f"unknown calendar {calendar_id!r}; known: {sorted(CALENDARS)}")
    return CALENDARS[calendar_id][0](dates)


def attach_sessions(
    rows: DataFrame, sessions: DataFrame, *, tz: str, at: str = "bar_start"
) -> DataFrame:
    """Session date, open and close of the session that holds ``at``, else nulls.

    Sessions never cross local midnight, so this is an equi-join on the local date. Spark
    broadcasts the session table when its size is under the session's threshold.
    """
    table = sessions.select(
        F.col("session_date").alias("__date"),
        F.col("session_open").alias("__open"),
        F.col("session_close").alias("__close"),
    )
    local = rows.withColumn("__day", F.to_date(F.from_utc_timestamp(F.col(at), tz)))
    joined = local.join(table, F.col("__day") == F.col("__date"), "left")
    inside = (F.col(at) >= F.col("__open")) & (F.col(at) < F.col("__close"))
    return joined.select(
        *rows.columns,
        F.when(inside, F.col("__date")).alias("session_date"),
        F.when(inside, F.col("__open")).alias("session_open"),
        F.when(inside, F.col("__close")).alias("session_close"),
    )


def in_session(rows: DataFrame, sessions: DataFrame, *, tz: str, at: str) -> DataFrame:
    """Point lookup on any time column: adds ``is_open``."""
    found = attach_sessions(rows, sessions, tz=tz, at=at)
    flagged = found.withColumn("is_open", F.col("session_open").isNotNull())
    return flagged.drop("session_date", "session_open", "session_close")
