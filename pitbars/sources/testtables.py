"""Bars, ledgers and side tables derived from the star-schema test tables.

Each definition has a SQL twin in :mod:`pitbars.plans.oracles`; both read whole tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitbars.functions.scalars import bucket_of, shift
from pitbars.operators.resample import bars_from_events
from pitbars.session import prepare
from pitbars.types import HOUR, MINUTE


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zone-less timestamps are declared to be UTC here and nowhere else."""
    df = prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the comparison tables have them."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _event_quantity() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("k", _event_quantity())


def bars(spark: SparkSession, sf_dir: str, size: str = "1h", by: str = "event_type") -> DataFrame:
    """Bars per event type (or user); every 17th epoch hour is published 90 minutes late."""
    made = bars_from_events(
        events(spark, sf_dir),
        instrument=by,
        at="ts",
        price="value",
        quantity="k",
        tiebreak="event_id",
        bar_size=size,
    )
    hour = bucket_of(F.unix_micros("bar_start"), HOUR)
    late = F.when(F.pmod(hour, F.lit(17)) == 0, shift("available_at", 90 * MINUTE))
    return made.withColumn("available_at", F.coalesce(late, F.col("available_at")))


def revised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars plus a second revision of every 23rd epoch hour, three hours later."""
    base = bars(spark, sf_dir)
    hour = bucket_of(F.unix_micros("bar_start"), HOUR)
    second = base.where(F.pmod(hour, F.lit(23)) == 0).withColumns(
        {
            "revision": F.lit(1),
            "close": F.round(F.col("close") * 1.0001, 6),
            "available_at": shift("available_at", 3 * HOUR),
        }
    )
    return base.unionByName(second)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill ledger from line items: one instrument per part."""
    li = load(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    buy = F.col("l_linestatus") == "O"
    spread = price * F.col("l_discount") / 1000
    reference = F.when(buy, price - spread).otherwise(price + spread)
    return li.select(
        F.col("l_partkey").cast("string").alias("instrument_id"),
        F.when(buy, "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").alias("fill_at"),
        reference.alias("reference_price"),
        spread.alias("half_spread"),
        F.lit(0.0).alias("slippage"),
        price.alias("price"),
        (price * F.col("l_quantity") * F.col("l_tax") / 100).alias("fee"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("maker"),
    )


FILL_ORDER = ["fill_at", "order_key", "line", "maker"]
