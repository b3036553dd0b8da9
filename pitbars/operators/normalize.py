"""From source rows to canonical bars: edges, availability, identity, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions.scalars import shift
from pitbars.types import micros, require_columns

BAR_KEY = ["instrument_id", "bar_size", "bar_start"]
DUPLICATE_POLICIES = ("error", "keep_highest_revision", "keep_first")


def bar_bounds(rows: DataFrame, *, at: str, label: str, bar_size: str) -> DataFrame:
    """Both edges of each bar from one labelled timestamp; the label has no default."""
    if label == "bar_start":
        edges = {"bar_start": F.col(at), "bar_end": shift(at, bar_size)}
    elif label == "bar_end":
        edges = {"bar_start": shift(at, bar_size, -1), "bar_end": F.col(at)}
    else:
        raise ValueError(f"label must be bar_start or bar_end, not {label!r}")
    return rows.withColumns(edges)


def with_availability(rows: DataFrame, *, latency, source: str | None = None) -> DataFrame:
    """The provider's own availability column when it has one, else ``bar_end + latency``."""
    ready = F.col(source) if source is not None else shift("bar_end", latency)
    return rows.withColumn("available_at", ready)


def aliases_of(instruments: DataFrame, source: str) -> DataFrame:
    """Effective-dated symbols of one source, one row per alias."""
    return (
        instruments.select("instrument_id", F.explode("aliases").alias("a"))
        .where(F.col("a.source") == source)
        .select("instrument_id", "a.symbol", "a.source", "a.effective_from", "a.effective_to")
    )


def resolve_symbols(
    rows: DataFrame, aliases: DataFrame, *, symbol: str, at: str
) -> tuple[DataFrame, DataFrame]:
    """Rows with the identity valid at their own time, and the symbols that have none.

    The second result lists each unmapped symbol with its row count.
    """
    table = aliases.select(
        F.col("symbol").alias("__symbol"), "instrument_id", "effective_from", "effective_to"
    )
    covers = (
        (F.col(symbol) == F.col("__symbol"))
        & (F.col(at) >= F.col("effective_from"))
        & (F.col("effective_to").isNull() | (F.col(at) < F.col("effective_to")))
    )
    joined = rows.join(table, covers, "left").drop("__symbol", "effective_from", "effective_to")
    resolved = joined.where(F.col("instrument_id").isNotNull())
    unmapped = (
        joined.where(F.col("instrument_id").isNull())
        .groupBy(F.col(symbol).alias("symbol"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return resolved, unmapped


def alias_overlaps(aliases: DataFrame, keys: Sequence[str] = ("instrument_id", "source")) -> DataFrame:
    """Aliases that start before the previous one of the same key has ended.

    Use ``keys=("source", "symbol")`` for the check across instruments.
    """
    w = Window.partitionBy(*keys).orderBy("effective_from", "symbol")
    reach = w.rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.lit("9999-12-31 00:00:00").cast("timestamp")
    ends = F.max(F.coalesce("effective_to", open_end)).over(reach)
    return aliases.withColumn("previous_end", ends).where(F.col("effective_from") < F.col("previous_end"))


def duplicate_rows(rows: DataFrame, keys: Sequence[str] = tuple(BAR_KEY)) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def apply_duplicate_policy(
    rows: DataFrame, policy: str, *, order: Sequence[str] = ("available_at", "source_key")
) -> DataFrame:
    """One row per ``(instrument, size, start)``.

    ``keep_first`` takes the least row by ``order``, a stated column order rather than the
    order rows happen to arrive in. Both keep policies are aggregates with map-side
    combining, so many copies of one key do not meet in one sort.
    """
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"unknown duplicate policy {policy!r}; known: {DUPLICATE_POLICIES}")
    if policy == "error":
        sample = duplicate_rows(rows).orderBy(*BAR_KEY).limit(5).collect()
        if sample:
            raise ValueError(f"duplicate bars, for example {[tuple(r) for r in sample]}")
        return rows
    require_columns(rows, [*BAR_KEY, "revision", *order], "duplicate policy")
    rest = [c for c in rows.columns if c not in BAR_KEY]
    payload = F.struct(*rest)
    if policy == "keep_highest_revision":
        kept = F.max_by(payload, F.struct("revision", *order))
    else:
        kept = F.min_by(payload, F.struct(*order, "revision"))
    return (
        rows.groupBy(*BAR_KEY).agg(kept.alias("__row")).select(*BAR_KEY, "__row.*")
        .select(*rows.columns)
    )


def _finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def contract_rules() -> dict[str, Column]:
    """What every canonical bar must satisfy; each rule is true when the row is sound."""
    low, high = F.col("low"), F.col("high")
    body_low, body_high = F.least("open", "close"), F.greatest("open", "close")
    return {
        "finite_prices": _finite("open", "high", "low", "close", "volume"),
        "positive_prices": (F.least("open", "high", "low", "close") > 0),
        "low_bounds": low <= body_low,
        "high_bounds": high >= body_high,
        "volume_not_negative": F.col("volume") >= 0,
        "vwap_in_range": F.col("vwap").isNull()
        | F.col("vwap").between(low * (1 - 1e-9), high * (1 + 1e-9)),
        "trades_not_negative": F.coalesce(F.col("trade_count") >= 0, F.lit(True)),
        "interval_ordered": F.col("bar_start") < F.col("bar_end"),
        "not_early": F.col("available_at") >= F.col("bar_end"),
        "revision_not_negative": F.col("revision") >= 0,
    }


def contract_violations(bars: DataFrame) -> DataFrame:
    """One row per bar and broken rule, found in a single pass without a shuffle."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in contract_rules().items()]
    return bars.withColumn("rule", F.explode(F.array_compact(F.array(*broken))))
