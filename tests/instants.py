"""Instants and row lists that several test modules use."""

import datetime as dt

T0 = dt.datetime(2024, 3, 4, tzinfo=dt.timezone.utc)


def at(minutes: float, seconds: float = 0) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def rows_of(df, *order):
    """Rows as tuples, with timestamps as aware UTC instants."""
    out = []
    for r in df.orderBy(*order).collect() if order else df.collect():
        out.append(tuple(v.astimezone(dt.timezone.utc) if isinstance(v, dt.datetime) else v for v in r))
    return out
