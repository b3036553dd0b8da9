"""Order-independent content digests as one aggregate."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.types import BAR_COLUMNS

BAR_CONTENT = [c for c in BAR_COLUMNS if c not in ("ingested_at", "source_key")]
FILL_CONTENT = ("fold", "role", "instrument_id", "fill_at", "side", "quantity", "price", "fee")
CURVE_CONTENT = ("fold", "role", "at", "equity", "cash")

_SEPARATOR = "\u0001"


def _text(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    value = F.unix_micros(column) if kind == "timestamp" else F.col(column)
    return F.coalesce(value.cast("string"), F.lit("\u0000"))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws(_SEPARATOR, *[_text(df, c) for c in columns]), 256)


def digest(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` and two sums of 60-bit hash slices: equal for equal row multisets.

    A sum does not depend on row order, combines on the map side, and keeps duplicates
    apart from single rows, which an exclusive-or would not. Slices are summed in parts of 20
    bits, as plain integers that hold for 2**43 rows, and put together once at the end.
    """
    hashed = df.select(*keys, row_hash(df, columns).alias("h"))
    slices = {"low": 1, "high": 16}
    h = hashed.select(*keys, *[F.conv(F.substring("h", s, 15), 16, 10).cast("bigint").alias(n) for n, s in slices.items()])

    def part(name: str, i: int) -> Column:
        return F.sum(F.shiftright(name, 20 * i).bitwiseAND(F.lit(2**20 - 1))).alias(f"__{name}{i}")

    def whole(name: str) -> Column:
        high, middle, low = (F.col(f"__{name}{i}").cast("decimal(20,0)") for i in (2, 1, 0))
        step = F.lit(2**20).cast("decimal(10,0)")
        upper = (high * step + middle).cast("decimal(28,0)")
        return (upper * step + low).cast("decimal(38,0)").alias(name)

    sums = h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[part(name, i) for name in slices for i in range(3)]
    )
    return sums.select(*keys, "rows", *[whole(name) for name in slices])


def digest_text(df: DataFrame, columns: Sequence[str]) -> str:
    """The digest as hex text. One aggregated row reaches the driver."""
    row = digest(df, columns).first()
    return hashlib.sha256(f"{row['rows']}:{row['low']}:{row['high']}".encode()).hexdigest()


def economic_digest(fills: DataFrame, curve: DataFrame) -> str:
    """What happened to the money: fills and equity, without bookkeeping columns."""
    parts = [
        digest_text(df, [c for c in wanted if c in df.columns])
        for df, wanted in ((fills, FILL_CONTENT), (curve, CURVE_CONTENT))
    ]
    return hashlib.sha256(":".join(parts).encode()).hexdigest()
