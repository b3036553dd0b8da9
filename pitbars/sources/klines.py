"""Exchange JSON: positional kline arrays to bars, instrument listings to a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import instant, shift
from pitbars.types import BAR_COLUMNS, micros

# Positions of the fields in a kline array.
KLINE_FIELDS = {
    "open_ms": 0,
    "open": 1,
    "high": 2,
    "low": 3,
    "close": 4,
    "volume": 5,
    "close_ms": 6,
    "quote_volume": 7,
    "trades": 8,
}

INFO_SCHEMA = (
    "symbols ARRAY<STRUCT<symbol: STRING, status: STRING, baseAsset: STRING, quoteAsset: STRING, "
    "filters: ARRAY<STRUCT<filterType: STRING, tickSize: STRING, stepSize: STRING>>>>"
)


def parse_klines(
    payloads: DataFrame,
    *,
    instrument: str,
    json: str,
    bar_size: str,
    latency,
    source: str,
    closed_before=None,
    label: str = "bar_start",
    source_revision: int = 0,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Bars from kline arrays, one JSON document per row.

    Klines are labelled by their start; another label is refused. A close time that does
    not fit the interval fails the query. Bars not closed before ``closed_before`` drop
    out, and repeats of one open time are merged.
    """
    if label != "bar_start":
        raise ValueError("klines are labelled by the interval start")
    fields = F.from_json(F.col(json), "ARRAY<ARRAY<STRING>>")
    flat = payloads.select(F.col(instrument).alias("instrument_id"), F.explode(fields).alias("k"))
    parts = {name: F.col("k")[i] for name, i in KLINE_FIELDS.items()}
    rows = flat.select(
        "instrument_id",
        *[parts[n].cast("bigint").alias(n) for n in ("open_ms", "close_ms", "trades")],
        *[
            parts[n].cast("double").alias(n)
            for n in ("open", "high", "low", "close", "volume", "quote_volume")
        ],
    )
    step = micros(bar_size)
    fits = (F.col("close_ms") + 1) * 1000 == F.col("open_ms") * 1000 + step
    refuse = F.raise_error(F.concat(F.lit("kline close does not fit "), F.lit(bar_size)))
    rows = rows.where(F.when(fits, True).otherwise(refuse))
    now_ms = F.unix_millis(F.current_timestamp())
    limit = now_ms if closed_before is None else F.least(F.unix_millis(instant(closed_before)), now_ms)
    rows = rows.where(F.col("close_ms") < limit)
    start = F.timestamp_millis("open_ms")
    bars = rows.select(
        "instrument_id",
        F.lit(bar_size).alias("bar_size"),
        start.alias("bar_start"),
        shift(start, step).alias("bar_end"),
        shift(shift(start, step), latency).alias("available_at"),
        *["open", "high", "low", "close", "volume"],
        F.when(F.col("volume") > 0, F.col("quote_volume") / F.col("volume")).alias("vwap"),
        F.col("trades").alias("trade_count"),
        F.lit(source).alias("source"),
        F.concat_ws(":", "instrument_id", F.col("open_ms").cast("string")).alias("source_key"),
        F.lit(source_revision).cast("int").alias("revision"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )
    return bars.dropDuplicates(["instrument_id", "bar_start"]).select(*BAR_COLUMNS)


def instruments_from_info(
    payloads: DataFrame,
    *,
    json: str,
    venue: str,
    source: str,
    calendar_id: str = "24x7:1",
    asset_class: str = "crypto",
    listed_from="2015-01-01T00:00:00+00:00",
) -> DataFrame:
    """Instrument rows from an exchange listing: increments, assets, and one alias each."""
    listed = payloads.select(F.inline(F.from_json(F.col(json), INFO_SCHEMA)["symbols"]))

    def increment(kind: str, field: str, default: str) -> Column:
        found = F.get(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(0))[field]
        return F.coalesce(found, F.lit(default)).cast("decimal(38,18)")

    alias = F.struct(
        F.col("symbol").alias("symbol"),
        F.lit(source).alias("source"),
        instant(listed_from).alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"),
    )
    return listed.select(
        F.concat_ws(":", F.upper(F.lit(asset_class)), F.col("symbol")).alias("instrument_id"),
        F.lit(asset_class).alias("asset_class"),
        F.lit(venue).alias("venue"),
        F.col("baseAsset").alias("base_currency"),
        F.col("quoteAsset").alias("quote_currency"),
        increment("PRICE_FILTER", "tickSize", "0.01").alias("price_increment"),
        increment("LOT_SIZE", "stepSize", "0.00000001").alias("quantity_increment"),
        F.lit(calendar_id).alias("calendar_id"),
        F.array(alias).alias("aliases"),
        F.col("status"),
    )
