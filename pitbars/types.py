"""Fixed table schemas and canonical durations."""

from __future__ import annotations

import datetime as dt
import re

# Column order and types of the canonical tables.
BAR_SCHEMA = (
    "instrument_id STRING, bar_size STRING, bar_start TIMESTAMP, bar_end TIMESTAMP, "
    "available_at TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume DOUBLE, vwap DOUBLE, trade_count BIGINT, source STRING, source_key STRING, "
    "revision INT, ingested_at TIMESTAMP"
)
BAR_COLUMNS = [part.split()[0] for part in BAR_SCHEMA.split(", ")]
NATURAL_KEY = ["instrument_id", "bar_size", "bar_start", "revision"]

INSTRUMENT_SCHEMA = (
    "instrument_id STRING, asset_class STRING, venue STRING, base_currency STRING, "
    "quote_currency STRING, price_increment DECIMAL(38,18), quantity_increment DECIMAL(38,18), "
    "calendar_id STRING, aliases ARRAY<STRUCT<symbol: STRING, source: STRING, "
    "effective_from: TIMESTAMP, effective_to: TIMESTAMP>>"
)
FOLD_SCHEMA = "fold INT, role STRING, start TIMESTAMP, end TIMESTAMP"
FINDING_SCHEMA = (
    "check STRING, severity STRING, message STRING, instrument_id STRING, "
    "occurrences BIGINT, sample ARRAY<STRING>"
)
ROLES = ("train", "validation", "test", "warmup", "purge", "embargo")

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_DURATION = re.compile(r"([1-9][0-9]*)([smhd])")

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(duration: str | dt.timedelta | int) -> int:
    """A duration as whole microseconds: ``'5m'``, a timedelta, or microseconds already."""
    if isinstance(duration, bool):
        raise TypeError("a duration cannot be a boolean")
    if isinstance(duration, int):
        return duration
    if isinstance(duration, dt.timedelta):
        return duration // dt.timedelta(microseconds=1)
    match = _DURATION.fullmatch(duration)
    if match is None:
        raise ValueError(f"invalid duration {duration!r}; write it as 30s, 5m, 1h or 1d")
    return int(match[1]) * _UNIT_SECONDS[match[2]] * SECOND


def format_micros(value: int) -> str:
    """Canonical spelling: the largest unit that divides the duration."""
    if value <= 0 or value % SECOND:
        raise ValueError(f"{value} us is not a positive whole number of seconds")
    seconds = value // SECOND
    unit = next(u for u in "dhms" if seconds % _UNIT_SECONDS[u] == 0)
    return f"{seconds // _UNIT_SECONDS[unit]}{unit}"


def utc(moment: dt.datetime | str) -> dt.datetime:
    """An aware UTC instant; naive input is refused."""
    value = dt.datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    if value.tzinfo is None or value.utcoffset() is None:
        raise ValueError(f"naive timestamp {value!r}; state an offset")
    return value.astimezone(dt.timezone.utc)


def require_columns(df, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: columns {missing} are not present in {df.columns}")
