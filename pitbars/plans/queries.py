"""Named queries over the test tables, one per operator of the survey.

Each function takes ``(spark, sf_dir)`` and reads whole tables. Doubles are rounded and
timestamps lose their zone only at this boundary, so results compare with plain SQL.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.functions import features as ft
from pitbars.functions.scalars import bucket_of, floor_time, instant, shift
from pitbars.operators import calendars as cal
from pitbars.operators import execution as ex
from pitbars.operators import joins, leakage, ledger, metrics, normalize, quality, runs
from pitbars.operators import sizing, splits, targets, transforms
from pitbars.operators.crosssection import CrossMean, CrossRank, cross_section
from pitbars.operators.features import compute_features
from pitbars.operators.resample import latest_revisions, periodic_equity, resample
from pitbars.plans import backtest as bt
from pitbars.plans.ingest import derive
from pitbars.session import prepare, scratch, staged
from pitbars.sources import digests, klines
from pitbars.sources import testtables as tt
from pitbars.sources.catalog import BarCatalog, dataset_id, head, partition_stats, point_in_time, register_asof
from pitbars.sources.files import Source, read_bars
from pitbars.sources.ledgers import LedgerStore, write_features
from pitbars.streaming import bars as streaming
from pitbars.types import DAY, HOUR, MINUTE, SECOND

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-20T00:00:00+00:00"
START = "2024-01-05T00:00:00+00:00"
END = "2024-01-25T00:00:00+00:00"
PLAN = splits.WalkForward(
    train="7d", validation="2d", test="2d", purge="1h", warmup="1d", embargo="6h"
)
ORDERING = tt.FILL_ORDER


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Doubles (or ``only`` these) on a grid whose rounding points lie off the decimal halves.

    Prices in cents make exact halves common, and engines settle those differently.
    """
    scale = 10.0**digits
    off = F.lit(0.0137)
    doubles = only or [c for c, t in df.dtypes if t == "double"]
    grid = {c: F.rint(F.col(c) * scale + off) / scale + F.lit(0.0) for c in doubles}
    return tt.zoneless(df.withColumns(grid) if doubles else df)


def query(digits: int = 6) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, d: rounded(fn(spark, d), digits)
        return fn

    return add


def hour_of(column: str = "bar_start") -> F.Column:
    return bucket_of(F.unix_micros(column), HOUR)


# -- sources and scans -----------------------------------------------------------------------


@query()
def build_bars_from_events(spark, d):
    return tt.bars(spark, d).drop("source_key", "ingested_at", "source")


@query()
def pit_lagged_return(spark, d):
    """The flagship: events to bars to a gap-aware return to an as-of read."""
    made = compute_features(tt.bars(spark, d), [ft.lagged_return(1)], bar_size="1h")
    return made.where(F.col("available_at") <= instant(AS_OF))


@query()
def scan_point_in_time(spark, d):
    return point_in_time(
        tt.bars(spark, d), as_of=AS_OF, start=START, end=END, bar_size="1h",
        instruments=["click", "view", "signup"],
        columns=["instrument_id", "bar_start", "available_at", "close", "volume"],
    )


@query()
def scan_as_of_revisions(spark, d):
    seen = point_in_time(tt.revised_bars(spark, d), as_of=AS_OF)
    return seen.select("instrument_id", "bar_start", "available_at", "close", "revision")


@query()
def scan_sql_asof_function(spark, d):
    tt.revised_bars(spark, d).createOrReplaceTempView("bars_sql")
    register_asof(spark, "bars_sql", "bars_sql_asof")
    return spark.sql(
        "SELECT instrument_id, bar_start, revision, close FROM "
        "bars_sql_asof(TIMESTAMP '2024-01-20 00:00:00') WHERE volume > 0"
    )


@query()
def scan_head(spark, d):
    seen = point_in_time(tt.bars(spark, d), as_of=AS_OF)
    return head(seen, 20).select("instrument_id", "bar_start", "revision", "close")


@query()
def scan_recent_rows(spark, d):
    seen = targets.recent_rows(tt.bars(spark, d), AS_OF, 5)
    return seen.select("instrument_id", "bar_start", "available_at", "close")


@query()
def catalog_partition_stats(spark, d):
    dated = tt.bars(spark, d).withColumn("date", floor_time("bar_start", DAY))
    return partition_stats(dated)


def _stored(spark, d, **options) -> tuple[BarCatalog, str]:
    """The revised bars as a stored dataset of a catalog of its own."""
    catalog = BarCatalog(spark, scratch(spark, "catalog"))
    dataset, existed = catalog.write(
        staged(tt.revised_bars(spark, d), "bars"), {"source": "events", "bar_size": "1h"}, **options
    )
    assert not existed
    return catalog, dataset


@query()
def catalog_pruned_partitions(spark, d):
    """The days a read has to open, from the stored metadata, with the rows they hold."""
    catalog, dataset = _stored(spark, d)
    days = catalog.selected_dates(dataset, as_of=AS_OF, start=START, end=END)
    held = catalog.tables()["dataset_partitions"].where(F.col("dataset") == dataset)
    return held.where(F.col("date").isin(days)).select("date", "row_count")


@query()
def catalog_stored_scan(spark, d):
    catalog, dataset = _stored(spark, d)
    seen = catalog.scan(dataset, as_of=AS_OF, start=START, end=END, bar_size="1h")
    return seen.select("instrument_id", "bar_start", "available_at", "close", "revision")


@query()
def catalog_stored_asof(spark, d):
    """The SQL table function over a stored dataset, with a predicate on top."""
    catalog, dataset = _stored(spark, d)
    seen = catalog.query_asof(dataset, AS_OF, where="volume > 0")
    return seen.select("instrument_id", "bar_start", "revision", "close")


@query()
def catalog_unfiltered(spark, d):
    catalog, dataset = _stored(spark, d)
    rows = catalog.scan_unfiltered(dataset, reason="count every stored row")
    held = rows.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows"), F.max("revision").alias("revision"))
    return held.withColumn("identified", F.lit(dataset == dataset_id({"source": "events", "bar_size": "1h"})))


@query()
def catalog_derived_daily(spark, d):
    """Daily bars as a dataset of their own that names its parent."""
    catalog, dataset = _stored(spark, d)
    coarse, _ = derive(catalog, dataset, source_size="1h", target_size="1d")
    rows = catalog.scan_unfiltered(coarse, reason="report the derived dataset")
    return rows.select("instrument_id", "bar_size", "bar_start", "bar_end", "available_at", "open", "high", "low",
                       "close", "volume", "vwap", "trade_count", "revision")


@query()
def catalog_verify_altered(spark, d):
    """A stored dataset before and after the closes of its first day are written anew."""
    catalog, dataset = _stored(spark, d, hash_files=True)
    before = catalog.verify(dataset).select(F.lit("before").alias("moment"), "part")
    before = staged(before, "verified")
    stored = catalog.scan_unfiltered(dataset, reason="alter one stored day")
    day = stored.agg(F.min(F.to_date("bar_start"))).first()[0]
    altered = staged(
        stored.where(F.to_date("bar_start") == day).withColumn("close", F.col("close") + 0.5), "altered"
    )
    altered.write.mode("overwrite").parquet(f"{catalog.root}/bars/dataset={dataset}/date={day}")
    after = catalog.verify(dataset).select(F.lit("after").alias("moment"), "part")
    return before.unionByName(after)


@query()
def feature_store_round_trip(spark, d):
    """Stored feature rows next to the table that says what they are."""
    specs = [ft.lagged_return(1), ft.rolling_range(3)]
    path = scratch(spark, "features")
    write_features(_features(spark, d, specs), specs, path)
    about = spark.read.parquet(f"{path}/specs").agg(F.count_distinct("fingerprint").alias("specs"))
    rows = spark.read.parquet(f"{path}/rows").select("instrument_id", "bar_start", "ret_1", "range_3")
    return rows.withColumn("specs", about.scalar())


@query()
def ledger_store_round_trip(spark, d):
    """Fills of a published run, read back, and whether recomputed ones carry its digest."""
    f = tt.fills(spark, d).withColumns({"fold": F.lit(0), "role": F.lit("test")})
    curve = f.groupBy("fold", "role", F.col("fill_at").alias("at")).agg(
        F.count(F.lit(1)).cast("double").alias("equity"), F.max("line").cast("double").alias("cash")
    )
    frames = {"fills": staged(f, "fills"), "equity_curve": staged(curve, "curve")}
    store = LedgerStore(spark, scratch(spark, "ledgers"))
    store.publish("first", frames, {"experiment_id": "e"})
    again = store.reproduces("first", f, curve)
    changed = store.reproduces("first", f.withColumn("fee", F.col("fee") + 1), curve)
    read = store.load("fills", ["first"]).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("fills"), F.sum(F.col("quantity").cast("bigint")).alias("quantity")
    )
    return read.withColumns({"again": F.lit(again), "changed": F.lit(changed)})


@query()
def source_files_read(spark, d):
    """Bars written as CSV, gzipped CSV and Parquet, read back as one source with a revision each."""
    b = staged(tt.bars(spark, d), "bars")
    part = F.pmod(hour_of(), F.lit(3))
    plain = b.select(
        part.alias("part"), F.concat(F.lit("sym_"), "instrument_id").alias("symbol"), F.col("bar_start").alias("timestamp"),
        "open", "high", "low", "close", "volume", "vwap", "trade_count",
    )
    text = plain.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    base = scratch(spark, "files")
    for number, codec in ((0, "none"), (1, "gzip")):
        mine = text.where(F.col("part") == number).drop("part")
        mine.write.option("header", True).option("compression", codec).csv(f"{base}/{number}")
    plain.where("part = 2").drop("part").write.parquet(f"{base}/2")
    names = b.select("instrument_id", F.concat(F.lit("sym_"), "instrument_id").alias("symbol")).distinct()
    aliases = names.select(
        "instrument_id", "symbol", F.lit("s").alias("source"),
        F.timestamp_micros(F.lit(0)).alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"),
    )
    kinds = ("csv", "csv", "parquet")
    read, unmapped = read_bars(
        spark, [Source(f"{base}/{i}", kind, revision=i) for i, kind in enumerate(kinds)], aliases=aliases,
        bar_size="1h", label="bar_start", latency="2s", source="s",
        mapping={"vwap": "vwap", "trade_count": "trade_count"},
    )
    refused = unmapped.agg(F.count(F.lit(1))).scalar()
    return read.select("instrument_id", "bar_start", "available_at", "open", "close", "volume", "vwap", "trade_count",
                       "revision", refused.alias("unmapped"))


@query()
def feature_user_staged(spark, d):
    """A user's average true range: the previous close, the true range of it, then its mean."""
    before, true_range = ft.step_column("previous_close"), ft.step_column("true_range")
    steps = (
        ft.Step("previous_close", lambda w: F.lag("close", 1).over(w)),
        ft.Step(
            "true_range",
            lambda w: F.greatest("high", before) - F.least("low", before), uses=("previous_close",),
        ),
    )
    atr = ft.FeatureSpec(
        "atr_3", ("high", "low", "close"), 3, lambda w: F.avg(true_range).over(w.rowsBetween(-2, 0)),
        kind="user_atr", steps=steps,
    )
    gap = ft.FeatureSpec(
        "gap_1", ("open", "close"), 1, lambda w: F.col("open") / F.col(before) - 1, kind="user_gap", steps=steps[:1]
    )
    return _features(spark, d, [atr, gap, ft.rolling_volatility(5)])


@query()
def split_fixed(spark, d):
    """One stated fold with the gaps between its parts."""
    fold = splits.fixed_split(
        spark, train=("2024-01-03T00:00:00+00:00", "2024-01-15T00:00:00+00:00"),
        validation=("2024-01-15T06:00:00+00:00", "2024-01-20T00:00:00+00:00"),
        test=("2024-01-20T06:00:00+00:00", "2024-01-27T00:00:00+00:00"), warmup="1d", purge="2h", label_horizon="6h",
    )
    tagged = splits.assign_roles(tt.bars(spark, d), fold)
    return tagged.select("instrument_id", "bar_start", "split_role")


@query()
def digest_bars(spark, d):
    content = tt.bars(spark, d).select(
        "instrument_id", "bar_start", F.round(F.col("close") * 100).cast("bigint").alias("cents"),
        "trade_count",
    )
    out = digests.digest(content, ["instrument_id", "bar_start", "cents", "trade_count"])
    return out.select("rows", F.col("low").cast("string").alias("low"),
                      F.col("high").cast("string").alias("high"))


@query()
def digest_economic(spark, d):
    f = tt.fills(spark, d).select(
        "instrument_id", "fill_at", "side", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("order_key").alias("price"), F.col("line").alias("fee"),
    )
    columns = ["instrument_id", "fill_at", "side", "quantity", "price", "fee"]
    out = digests.digest(f, columns, keys=["side"])
    return out.select("side", "rows", F.col("low").cast("string").alias("low"),
                      F.col("high").cast("string").alias("high"))


# -- normalisation ---------------------------------------------------------------------------


@query()
def normalize_bar_bounds(spark, d):
    labelled = tt.events(spark, d).select("event_id", floor_time("ts", "5m").alias("label"))
    starts = normalize.bar_bounds(labelled, at="label", label="bar_start", bar_size="5m")
    ends = normalize.bar_bounds(labelled, at="label", label="bar_end", bar_size="5m")
    both = starts.withColumn("kind", F.lit("start")).unionByName(ends.withColumn("kind", F.lit("end")))
    return normalize.with_availability(both, latency="2s").drop("label")


def _aliases(spark, d):
    """Two identities per symbol: one until mid-month, then another (never for signups)."""
    symbol = tt.events(spark, d).select(F.col("event_type").alias("symbol")).distinct()
    turn = instant("2024-01-15T12:00:00+00:00")
    first = symbol.select(
        F.concat(F.lit("A:"), "symbol").alias("instrument_id"), "symbol", F.lit("src").alias("source"),
        instant("2023-01-01T00:00:00+00:00").alias("effective_from"), turn.alias("effective_to"),
    )
    second = symbol.where("symbol != 'signup'").select(
        F.concat(F.lit("B:"), "symbol").alias("instrument_id"), "symbol", F.lit("src").alias("source"),
        turn.alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"),
    )
    return first.unionByName(second)


@query()
def normalize_symbol_aliases(spark, d):
    rows = tt.events(spark, d).select("event_id", "event_type", "ts")
    resolved, _ = normalize.resolve_symbols(rows, _aliases(spark, d), symbol="event_type", at="ts")
    return resolved.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


@query()
def normalize_unmapped_symbols(spark, d):
    rows = tt.events(spark, d).select("event_id", "event_type", "ts")
    _, unmapped = normalize.resolve_symbols(rows, _aliases(spark, d), symbol="event_type", at="ts")
    return unmapped


@query()
def normalize_alias_overlaps(spark, d):
    orders = tt.load(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("instrument_id"),
        F.col("o_orderpriority").alias("source"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("symbol"),
        F.col("o_orderdate").alias("effective_from"),
        shift("o_orderdate", 30 * DAY).alias("effective_to"),
    )
    found = normalize.alias_overlaps(orders)
    return found.select("instrument_id", "source", "symbol", "effective_from", "previous_end")


@query()
def normalize_duplicates(spark, d):
    kept = normalize.apply_duplicate_policy(tt.revised_bars(spark, d), "keep_highest_revision")
    return kept.select("instrument_id", "bar_start", "revision", "close", "available_at")


@query()
def normalize_keep_first(spark, d):
    kept = normalize.apply_duplicate_policy(tt.revised_bars(spark, d), "keep_first")
    return kept.select("instrument_id", "bar_start", "revision", "close", "available_at")


@query()
def normalize_duplicate_keys(spark, d):
    return normalize.duplicate_rows(tt.revised_bars(spark, d))


@query()
def parse_kline_json(spark, d):
    b = tt.bars(spark, d)
    ms = F.unix_millis("bar_start")
    texts = [
        ms, "open", "high", "low", "close", "volume", ms + F.lit(HOUR // 1000 - 1),
        F.coalesce(F.col("vwap") * F.col("volume"), F.lit(0.0)), "trade_count",
    ]
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in texts]
    docs = b.groupBy("instrument_id", floor_time("bar_start", DAY).alias("day")).agg(
        F.to_json(F.collect_list(F.array(*parts))).alias("doc")  # at most 24 bars a day
    )
    made = klines.parse_klines(
        docs, instrument="instrument_id", json="doc", bar_size="1h", latency="2s",
        source="klines", closed_before=END,
    )
    return made.drop("ingested_at", "source")


@query()
def instruments_from_listing(spark, d):
    part = tt.load(spark, d, "part")
    status = F.when(F.col("p_size") % 2 == 0, "TRADING").otherwise("HALT")
    filters = F.array(
        F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.lit("0.01").alias("tickSize"),
                 F.lit(None).cast("string").alias("stepSize")),
        F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit(None).cast("string").alias("tickSize"),
                 (F.col("p_size") / 1000).cast("decimal(10,3)").cast("string").alias("stepSize")),
    )
    symbol = F.struct(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        status.alias("status"), F.col("p_brand").alias("baseAsset"), F.lit("USD").alias("quoteAsset"),
        filters.alias("filters"),
    )
    docs = part.select(F.to_json(F.struct(F.array(symbol).alias("symbols"))).alias("doc"))
    made = klines.instruments_from_info(docs, json="doc", venue="TEST", source="listing")
    return made.select(
        "instrument_id", "base_currency", "status",
        F.col("price_increment").cast("double").alias("price_increment"),
        F.col("quantity_increment").cast("double").alias("quantity_increment"),
        F.size("aliases").alias("alias_count"),
    )


# -- data quality ----------------------------------------------------------------------------


def _faulty(spark, d):
    """Hourly bars with faults at fixed epoch hours."""
    h = hour_of()
    bad = tt.bars(spark, d).withColumns(
        {
            "available_at": F.when(F.pmod(h, F.lit(29)) == 0, shift("bar_end", SECOND, -1)).otherwise(
                F.col("available_at")
            ),
            "bar_end": F.when(F.pmod(h, F.lit(31)) == 0, shift("bar_start", 30 * MINUTE)).otherwise(
                F.col("bar_end")
            ),
            "low": F.when(F.pmod(h, F.lit(37)) == 0, -F.col("low")).otherwise(F.col("low")),
            "high": F.when(F.pmod(h, F.lit(41)) == 0, F.col("low") / 2).otherwise(F.col("high")),
            "volume": F.when(F.pmod(h, F.lit(43)) == 0, -1.0).otherwise(F.col("volume")),
        }
    )
    return bad.unionByName(bad.where(F.pmod(h, F.lit(47)) == 0))


def _sampled(found):
    return found.select(
        "check", "severity", F.coalesce("instrument_id", F.lit("")).alias("instrument_id"),
        "occurrences", F.concat_ws("; ", "sample").alias("sample"),
    )


@query()
def quality_findings(spark, d):
    return _sampled(quality.validate(_faulty(spark, d), bar_size="1h", latency="2s"))


@query()
def quality_empty_and_unmapped(spark, d):
    """The gate on bars of a size that is not there, from a source with a symbol nobody knows."""
    rows = tt.events(spark, d).select("event_id", "event_type", "ts")
    _, unmapped = normalize.resolve_symbols(rows, _aliases(spark, d), symbol="event_type", at="ts")
    none = tt.bars(spark, d).where(F.col("bar_size") == "1s")
    found = staged(quality.validate(none, bar_size="1s", latency="2s", unmapped=unmapped), "findings")
    try:
        quality.refuse_on_error(found)
        refused = False
    except ValueError:
        refused = True
    return found.select("check", "severity", "occurrences", F.lit(refused).alias("refused"))


@query()
def quality_missing_grid(spark, d):
    return _sampled(quality.grid_findings(tt.bars(spark, d), "1h"))


@query()
def quality_missing_intervals(spark, d):
    return quality.missing_intervals(tt.bars(spark, d), "1h")


@query()
def quality_availability_order(spark, d):
    found = quality.out_of_order(tt.bars(spark, d), "1h")
    return found.select("instrument_id", "bar_start", "available_at", "previous_available_at")


@query()
def quality_contract_violations(spark, d):
    broken = normalize.contract_violations(_faulty(spark, d))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query()
def quality_outside_session(spark, d):
    b = tt.bars(spark, d)
    sessions = cal.xnys_sessions(cal.date_spine(b, "bar_start"))
    return _sampled(quality.session_findings(b, sessions, cal.NEW_YORK))


# -- calendars -------------------------------------------------------------------------------


@query()
def calendar_24x7(spark, d):
    dates = cal.date_spine(tt.load(spark, d, "orders"), "o_orderdate")
    s = cal.always_open_sessions(dates)
    return s.withColumn("session_date", F.col("session_date").cast("timestamp")).drop("early_close")


@query()
def calendar_xnys(spark, d):
    dates = cal.date_spine(tt.load(spark, d, "orders"), "o_orderdate")
    s = cal.xnys_sessions(dates)
    return s.withColumns(
        {"session_date": F.col("session_date").cast("timestamp"),
         "early_close": F.col("early_close").cast("int")}
    )


def _with_sessions(spark, d):
    b = tt.bars(spark, d, "15m")
    sessions = cal.xnys_sessions(cal.date_spine(b, "bar_start"))
    return cal.attach_sessions(b, sessions, tz=cal.NEW_YORK)


@query()
def calendar_attach_sessions(spark, d):
    return _with_sessions(spark, d).select(
        "instrument_id", "bar_start", F.col("session_date").cast("timestamp").alias("session_date"),
        "session_open", "session_close",
    )


@query()
def calendar_session_at(spark, d):
    b = tt.bars(spark, d)
    sessions = cal.xnys_sessions(cal.date_spine(b, "bar_start"))
    hit = cal.in_session(b, sessions, tz=cal.NEW_YORK, at="available_at")
    return hit.groupBy("instrument_id").agg(F.count_if("is_open").alias("open_rows"))


@query()
def window_session_features(spark, d):
    fs = [ft.minutes_since_open(), ft.minutes_to_close(), ft.session_fraction(), ft.is_early_close()]
    return compute_features(_with_sessions(spark, d), fs, bar_size="15m")


# -- joins -----------------------------------------------------------------------------------


def _user_events(spark, d):
    return tt.events(spark, d).select(
        F.col("event_type").alias("instrument_id"), "event_id", F.col("ts").alias("cutoff"), "user_id"
    )


def _bar_state(spark, d):
    return tt.bars(spark, d).select("instrument_id", "bar_start", "available_at", "close")


@query()
def join_asof(spark, d):
    return joins.asof_join(
        _user_events(spark, d), _bar_state(spark, d), as_of="cutoff", prefix="bar_"
    )


@query()
def join_asof_staleness(spark, d):
    return joins.asof_join(
        _user_events(spark, d), _bar_state(spark, d), as_of="cutoff", prefix="bar_",
        max_staleness="45m",
    )


@query()
def join_next_open(spark, d):
    opens = tt.bars(spark, d).select("instrument_id", "bar_start", "open")
    found = joins.first_open_after(_user_events(spark, d), opens, at="cutoff")
    return found.select(
        "event_id", F.col("next_open.bar_start").alias("open_at"), F.col("next_open.open").alias("open")
    )


@query()
def join_containing_bar(spark, d):
    opens = tt.bars(spark, d, "15m").select("instrument_id", "bar_start", "open")
    later = _user_events(spark, d).withColumn("cutoff", shift("cutoff", 7 * MINUTE))
    found = joins.containing_bar(later, opens, at="cutoff", step="15m")
    return found.select(
        "event_id", F.col("containing.bar_start").alias("open_at"),
        F.col("containing.open").alias("open"),
    )


# -- resampling ------------------------------------------------------------------------------


def _coarse(spark, d, size):
    known = latest_revisions(tt.revised_bars(spark, d))
    made = resample(known, source_size="1h", target_size=size)
    return made.drop("source_key", "ingested_at", "source")


@query()
def resample_4h(spark, d):
    return _coarse(spark, d, "4h")


@query()
def resample_1d(spark, d):
    return _coarse(spark, d, "1d")


@query()
def resample_periodic_equity(spark, d):
    orders = tt.load(spark, d, "orders").select(
        "o_orderpriority", F.col("o_orderdate").alias("day"), "o_orderkey",
        F.col("o_totalprice").alias("equity"),
    )
    at = F.timestamp_micros(F.unix_micros("day") + F.col("o_orderkey"))
    curve = orders.select("o_orderpriority", at.alias("at"), "equity")
    return periodic_equity(curve, keys=["o_orderpriority"], bar_size="7d")


# -- window features -------------------------------------------------------------------------


def _features(spark, d, fs, **kw):
    return compute_features(tt.bars(spark, d), fs, bar_size="1h", **kw)


@query()
def window_log_return(spark, d):
    return _features(spark, d, [ft.lagged_return(3, "log"), ft.lagged_return(2, contiguous=False)])


@query()
def window_volatility(spark, d):
    return _features(spark, d, [ft.rolling_volatility(5)])


@query()
def window_relative_volume(spark, d):
    return _features(spark, d, [ft.relative_volume(5)])


@query()
def window_zscore(spark, d):
    return _features(spark, d, [ft.rolling_zscore(6), ft.rolling_zscore(4, "volume")])


@query()
def window_range(spark, d):
    return _features(spark, d, [ft.rolling_range(4), ft.bar_range()])


@query()
def window_time_features(spark, d):
    fs = [ft.minute_of_day(), ft.minute_of_day("sin"), ft.minute_of_day("cos"), ft.day_of_week()]
    return _features(spark, d, fs)


@query()
def window_availability(spark, d):
    spec = ft.FeatureSpec(
        "mean_3", ("close",), 2, lambda w: F.avg("close").over(w.rowsBetween(-2, 0)),
        contiguous=False, latency_us=5 * SECOND, kind="custom",
    )
    return _features(spark, d, [spec]).select("instrument_id", "bar_start", "available_at")


@query()
def window_liquidity_estimates(spark, d):
    return ex.liquidity_estimates(tt.bars(spark, d), 5)


# -- cross-section ---------------------------------------------------------------------------


def _daily_users(spark, d):
    b = tt.bars(spark, d, "1d", by="user_id")
    return b.select("instrument_id", "bar_start", "available_at", "trade_count", "close")


@query()
def cross_rank(spark, d):
    return cross_section(_daily_users(spark, d), [CrossRank("close")])


@query()
def cross_rank_methods(spark, d):
    ranks = [
        CrossRank("trade_count", pct=False, method=m, name=f"rank_{m}", descending=(m == "min"))
        for m in ("average", "min", "max", "dense", "ordinal")
    ]
    return cross_section(_daily_users(spark, d), ranks)


def _crowded(spark, d):
    """Line items as members of seven yearly instants, with values within 5 % and one that repeats."""
    li = tt.load(spark, d, "lineitem")
    parts = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"]
    start = F.date_trunc("year", "l_shipdate")
    return li.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in parts[:4]], F.unix_micros("l_shipdate").cast("string")).alias("instrument_id"),
        start.alias("bar_start"), shift(start, DAY).alias("available_at"),
        (100 + F.pmod("l_partkey", F.lit(500)) / 100).alias("narrow"), F.lit(7.0).alias("same"),
    )


@query()
def cross_rank_close_values(spark, d):
    ranks = [CrossRank("narrow", pct=False, method=m, name=f"rank_{m}") for m in ("average", "dense", "ordinal")]
    return cross_section(_crowded(spark, d), ranks)


@query()
def cross_rank_repeated_value(spark, d):
    ranks = [CrossRank("same", pct=False, method=m, name=f"rank_{m}") for m in ("average", "max", "ordinal")]
    return cross_section(_crowded(spark, d), ranks).drop("narrow")


@query()
def quantiles_of_close_values(spark, d):
    rows = _crowded(spark, d).select(
        F.year("bar_start").alias("fold"), F.lit("train").alias("split_role"), "narrow", "same"
    )
    return transforms.fit_winsor(rows, ["narrow", "same"], lower=0.013, upper=0.77)


@query()
def cross_mean(spark, d):
    return cross_section(_daily_users(spark, d), [CrossMean("close", min_members=3)])


@query()
def cross_batch_availability(spark, d):
    lifted = cross_section(_daily_users(spark, d), [CrossMean("close")])
    return lifted.groupBy("bar_start").agg(
        F.min("available_at").alias("ready_from"), F.max("available_at").alias("ready_to"),
        F.count(F.lit(1)).alias("members"),
    )


# -- folds and transforms --------------------------------------------------------------------


def _span(spark, d):
    return _span_of(tt.bars(spark, d))


def _span_of(b):
    return b.agg(
        floor_time(F.min("bar_start"), DAY).alias("start"),
        shift(floor_time(F.max("bar_start"), DAY), DAY).alias("end"),
    )


def _folds(spark, d):
    return splits.walk_forward(_span(spark, d), PLAN)


@query()
def folds_rolling(spark, d):
    return _folds(spark, d)


@query()
def folds_expanding(spark, d):
    plan = splits.WalkForward(
        train="5d", test="3d", label_horizon="2h", step="2d", expanding=True, warmup="12h"
    )
    return splits.walk_forward(_span(spark, d), plan)


SEALED = [("holdout", "2024-01-09T00:00:00+00:00", "2024-01-10T00:00:00+00:00", "6h")]


@query()
def folds_excluding_sealed(spark, d):
    windows = splits.guarded(splits.sealed_windows(spark, SEALED))
    plan = splits.WalkForward(train="4d", test="2d", purge="1h", step="1d")
    return splits.walk_forward(_span(spark, d), plan, windows.select("start", "end"))


@query()
def folds_touching_sealed(spark, d):
    plan = splits.WalkForward(train="4d", test="2d", purge="1h", step="1d")
    folds = splits.walk_forward(_span(spark, d), plan)
    return splits.touching_folds(folds, splits.sealed_windows(spark, SEALED))


@query()
def sealed_exclusion(spark, d):
    """The predicate reaches the scan of the bars; the next query takes windows from a table."""
    kept = tt.bars(spark, d).where(splits.outside([w[1:] for w in SEALED]))
    return kept.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("trade_count").alias("trades")
    )


@query()
def sealed_exclusion_by_table(spark, d):
    """One window per supplier nation, so that many ranges exclude rows."""
    nations = tt.load(spark, d, "nation")
    start = F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + F.col("n_nationkey") * (14 * HOUR))
    windows = nations.select(
        F.col("n_name").alias("name"), start.alias("start"), shift(start, 3 * HOUR).alias("end"),
        (F.col("n_regionkey") * HOUR).cast("bigint").alias("gap_us"),
    )
    kept = splits.development_rows(tt.bars(spark, d), windows)
    return kept.select("instrument_id", "bar_start", "trade_count")


@query()
def folds_train_exclusions(spark, d):
    return splits.train_exclusions(_folds(spark, d))


@query()
def join_interval_roles(spark, d):
    tagged = splits.assign_roles(tt.bars(spark, d), _folds(spark, d))
    return tagged.select("instrument_id", "bar_start", "fold", "split_role")


def _scored(spark, d):
    made = _features(spark, d, [ft.lagged_return(1), ft.rolling_range(3)])
    return made


@query()
def transform_zscore(spark, d):
    folds, rows = _folds(spark, d), _scored(spark, d)
    columns = ["ret_1", "range_3"]
    stats = transforms.fit_zscore(splits.training_rows(rows, folds), columns)
    tagged = splits.assign_roles(rows, folds).where("split_role IN ('validation', 'test')")
    scaled = transforms.apply_zscore(tagged, stats, columns)
    return scaled.select("fold", "split_role", "instrument_id", "bar_start", *columns)


@query()
def transform_fit_winsor(spark, d):
    train = splits.training_rows(_scored(spark, d), _folds(spark, d))
    return transforms.fit_winsor(train, ["ret_1", "range_3"], lower=0.05, upper=0.9)


@query()
def transform_winsor(spark, d):
    folds, rows = _folds(spark, d), _scored(spark, d)
    stats = transforms.fit_winsor(splits.training_rows(rows, folds), ["ret_1"], lower=0.05, upper=0.9)
    clipped = transforms.apply_winsor(splits.assign_roles(rows, folds), stats, ["ret_1"])
    return clipped.select("fold", "split_role", "instrument_id", "bar_start", "ret_1")


def _fold_curves(spark, d):
    """A curve per priority (as role) and year (as fold), restarted every year."""
    o = tt.load(spark, d, "orders")
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey"))
    return o.select(
        F.col("o_orderpriority").alias("role"), F.year("o_orderdate").alias("fold"), at.alias("at"),
        (F.col("o_totalprice") / 1000 + 1000).alias("equity"),
        (F.col("o_totalprice") / 2000).alias("gross_exposure"),
        (F.col("o_totalprice") / 4000).alias("net_exposure"),
    )


@query(4)
def stitch_curves(spark, d):
    return metrics.stitch(_fold_curves(spark, d)).groupBy("role", "fold").agg(
        F.min_by("equity", "at").alias("first_equity"), F.max_by("equity", "at").alias("last_equity"),
        F.avg("gross_exposure").alias("mean_gross"),
    )


# -- leakage ---------------------------------------------------------------------------------


def _honest(rows):
    return compute_features(
        rows, [ft.lagged_return(1), ft.rolling_range(3)], bar_size="1h",
        keys=["cut", "instrument_id"],
    )


def _dishonest(rows):
    peek = ft.FeatureSpec(
        "peek", ("close",), 0, lambda w: F.lead("close", 1).over(w), contiguous=False, kind="peek"
    )
    return compute_features(
        rows, [peek], bar_size="1h", keys=["cut", "instrument_id"], chunk_rows=None
    )


@query()
def leak_cut_points(spark, d):
    return leakage.cut_points(tt.bars(spark, d))


def _leak_report(b, cuts, violations):
    """Per cut: rows the full computation marks available, and how many of them moved."""
    full = _honest(b.withColumn("cut", F.lit(cuts[0]))).drop("cut")
    full = full.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    checked = full.where(F.col("available_at") <= F.col("cut")).groupBy("cut").agg(
        F.count(F.lit(1)).alias("checked")
    )
    moved = violations.groupBy("cut").agg(F.count(F.lit(1)).alias("violations"))
    return checked.join(moved, "cut", "left").fillna(0)


def _cuts(b):
    """The cut points as instants; their number is a parameter."""
    return [r["cut"] for r in leakage.cut_points(b).orderBy("cut").collect()]


@query()
def leak_prefix_invariance(spark, d):
    b = staged(tt.bars(spark, d), "bars")
    cuts = leakage.cut_points(b)
    return _leak_report(b, _cuts(b), leakage.prefix_violations(b, _honest, cuts))


@query()
def leak_future_insensitive(spark, d):
    b = staged(tt.bars(spark, d), "bars")
    cuts = leakage.cut_points(b)
    return _leak_report(b, _cuts(b), leakage.future_violations(b, _honest, cuts))


@query()
def leak_prefix_caught(spark, d):
    b = tt.bars(spark, d)
    found = leakage.prefix_violations(b, _dishonest, leakage.cut_points(b))
    return found.select("cut", "instrument_id", "bar_start", "feature")


# -- targets ---------------------------------------------------------------------------------

RULE = {
    "long_when": {
        "all_of": [
            {"feature": "ret_1", "op": ">", "value": 0.1},
            {"not": {"feature": "range_3", "op": ">=", "value": 5.0}},
        ]
    },
    "short_when": {
        "any_of": [
            {"feature": "ret_1", "op": "<", "value": -0.8},
            {"feature": "bar_range", "op": ">", "other": "range_3"},
        ]
    },
    "weight": 0.25,
}


def _ruled(spark, d):
    return _features(spark, d, [ft.lagged_return(1), ft.rolling_range(3), ft.bar_range()])


@query()
def rule_targets(spark, d):
    made = targets.rule_targets(_ruled(spark, d), RULE)
    return made.select("instrument_id", "bar_start", "available_at", "target")


@query()
def rule_target_changes(spark, d):
    """What a book does to follow a rule, closing names that stop qualifying or have no row."""
    made = targets.rule_targets(
        _ruled(spark, d), RULE, max_positions=2, rank_by="ret_1", at="bar_start"
    )
    clock = tt.bars(spark, d).select("bar_start")
    return targets.rule_changes(made, clock, at="bar_start")


@query()
def rule_topk(spark, d):
    made = targets.rule_targets(
        _ruled(spark, d), RULE, max_positions=2, rank_by="ret_1", at="bar_start"
    )
    return made.select("instrument_id", "bar_start", "target")


@query()
def lagged_signal_targets(spark, d):
    made = _features(spark, d, [ft.lagged_return(1)])
    signal = targets.lagged_signal(made, "ret_1", weight=0.2)
    return targets.target_changes(signal).select("instrument_id", "decision_at", "bar_start", "target")


def _stretch(spark, d):
    return _features(spark, d, [ft.rolling_zscore(4), ft.rolling_range(3)])


@query()
def hysteresis_one_sided(spark, d):
    made = targets.hysteresis_long(
        _stretch(spark, d), zscore="zscore_4", entry_z=1.0, exit_z=0.2, gate=F.col("range_3") > 1.0
    )
    return made.select("instrument_id", "bar_start", "state")


@query()
def hysteresis_episodes(spark, d):
    made = targets.hysteresis(
        _stretch(spark, d), zscore="zscore_4", entry_z=1.0, exit_z=0.2,
        rank_feature="range_3", min_rank=0.5,
    )
    return made.select("instrument_id", "bar_start", "state")


@query()
def scheduled_targets(spark, d):
    b = tt.bars(spark, d)
    chosen = targets.scheduled(targets.decision_instants(b), "7h")
    weights = {"click": 0.3, "view": 0.2}
    return targets.weights_at(chosen, b, weights)


@query()
def initial_allocation(spark, d):
    b = tt.bars(spark, d)
    instants = targets.decision_instants(b, start="2024-01-01T00:00:00+00:00")
    return targets.initial_allocation(instants, b, {"click": 0.3, "view": 0.2, "error": 0.1})


@query()
def decision_batches(spark, d):
    b = tt.bars(spark, d).select("instrument_id", "bar_start", "available_at", "close")
    instants = targets.decision_instants(b, start=START, end=AS_OF)
    return targets.decision_batches(b, instants)


# -- execution -------------------------------------------------------------------------------


def _orders(spark, d, size="1h"):
    """One order for every bar, sized so that the cap usually splits it."""
    b = staged(tt.bars(spark, d, size), "bars")
    asked = b.select(
        "instrument_id",
        F.col("available_at").alias("signal_at"),
        F.when(F.col("close") > F.col("open"), "buy").otherwise("sell").alias("side"),
        (F.col("trade_count") * 5).cast("double").alias("quantity"),
        F.lit(0.01).alias("increment"),
        F.concat_ws("|", "instrument_id", F.unix_micros("bar_start").cast("string")).alias("order_id"),
    )
    timed = ex.order_times(asked, ex.Execution(order_latency="1s", expire_after="6h"))
    estimates = ex.liquidity_estimates(b, 5)
    return staged(ex.attach_estimates(timed, estimates), "orders"), b


def _matched(spark, d, rule):
    orders, b = _orders(spark, d)
    how = ex.Execution(order_latency="1s", expire_after="6h", fill_rule=rule)
    return orders, staged(ex.match_orders(orders, b, how, step="1h"), "fills")


@query()
def match_orders_next_open(spark, d):
    _, fills = _matched(spark, d, "next_open_after_eligibility")
    return fills.select("order_id", "fill_at", "reference_price", "quantity")


@query()
def match_orders_current_bar(spark, d):
    _, fills = _matched(spark, d, "open_of_current_bar")
    return fills.select("order_id", "fill_at", "reference_price", "quantity")


@query()
def match_orders_unfilled(spark, d):
    orders, fills = _matched(spark, d, "next_open_after_eligibility")
    return ex.unfilled(orders, fills)


def _costed(spark, d, scenarios=("base",)):
    _, fills = _matched(spark, d, "next_open_after_eligibility")
    return ex.execution_costs(ex.with_scenarios(fills, scenarios))


@query()
def execution_costs(spark, d):
    f = _costed(spark, d)
    return f.select("order_id", "fill_at", "half_spread", "slippage", "price", "fee", "participation")


@query()
def execution_sqrt_impact(spark, d):
    _, fills = _matched(spark, d, "next_open_after_eligibility")
    costs = ex.Costs(1.0, 2.0, "sqrt_impact", 0.05, 7.0, 0.001, 0.02)
    f = ex.execution_costs(ex.with_costs_of(fills, costs))
    return f.select("order_id", "fill_at", "slippage", "price", "fee")


@query(4)
def cost_scenarios(spark, d):
    f = _costed(spark, d, None)
    return metrics.cost_split(f, ["scenario", "side"])


@query()
def execution_chain_violations(spark, d):
    f = _costed(spark, d).withColumn(
        "eligible_at",
        F.when(F.pmod(F.unix_micros("signal_at"), F.lit(5)) == 0,
               shift("fill_at", SECOND)).otherwise(F.col("eligible_at")),
    )
    return ex.chain_violations(f).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def size_targets(spark, d):
    """Every order day is a decision; customers' orders are intents on the priority's book."""
    o = tt.load(spark, d, "orders")
    name = F.concat_ws("|", "o_custkey", "o_orderkey")
    idle = F.pmod("o_orderkey", F.lit(5)) == 4
    kind = (
        F.when(idle | (F.pmod("o_orderkey", F.lit(3)) == 0), "delta")
        .when(F.pmod("o_orderkey", F.lit(3)) == 1, "target_weight")
        .otherwise("target_quantity")
    )
    value = (
        F.when(idle, 0.0).when(F.pmod("o_orderkey", F.lit(3)) == 0, (F.pmod("o_custkey", F.lit(41)) - 20) * 2.5)
        .when(F.pmod("o_orderkey", F.lit(3)) == 1, (F.pmod("o_custkey", F.lit(23)) - 4) / 20)
        .otherwise((F.pmod("o_custkey", F.lit(31)) - 5) * 3.0)
    )
    base = o.select(
        F.col("o_orderdate").alias("decision_at"), name.alias("instrument_id"), kind.alias("kind"),
        value.cast("double").alias("value"),
        F.when(F.pmod("o_orderkey", F.lit(97)) == 0, shift("o_orderdate", SECOND))
        .otherwise(F.col("o_orderdate")).alias("created_at"),
        "o_orderkey", "o_custkey", "o_totalprice",
    )
    intents = base.select("decision_at", "created_at", "instrument_id", "kind", "value")
    # Some holdings go by another name, so that their intents find none. Marks are rounded half
    # up by sums that are exact at a half; what `round` makes of one differs between engines.
    other = F.when(F.pmod("o_orderkey", F.lit(89)) == 0, F.concat("instrument_id", F.lit("?")))
    holdings = base.select(
        "decision_at", F.coalesce(other, F.col("instrument_id")).alias("instrument_id"),
        F.when(F.pmod("o_orderkey", F.lit(83)) != 0, F.floor(F.col("o_totalprice") / 10 + 0.5) / 100).alias("mark"),
        (F.pmod("o_custkey", F.lit(7)) * 10).cast("double").alias("position"),
        (F.pmod("o_custkey", F.lit(3)) * 5).cast("double").alias("pending"),
        F.when(F.pmod("o_custkey", F.lit(2)) == 0, 1.0).otherwise(0.5).alias("increment"),
    )
    decisions = base.groupBy("decision_at").agg(
        (F.count(F.lit(1)) * 9000.0).alias("equity"), (F.count(F.lit(1)) * 2500.0).alias("cash")
    )
    out = sizing.size_targets(intents, decisions, holdings, sizing.Limits(max_weight=0.4))
    return out.select("decision_at", "instrument_id", "final_quantity",
                      F.coalesce("rejection", F.lit("")).alias("rejection"))


# -- ledgers ---------------------------------------------------------------------------------


@query()
def ledger_positions(spark, d):
    held = ledger.positions(tt.fills(spark, d), order=ORDERING, width=90 * DAY)
    return held.select("instrument_id", *ORDERING, "position_before", "position")


@query(4)
def ledger_average_cost(spark, d):
    out = ledger.average_cost(tt.fills(spark, d), order=ORDERING, width=90 * DAY)
    return out.select("instrument_id", *ORDERING, "position", "avg_cost", "realized_pnl")


def _book(spark, d):
    """Fills of the order book and closing-price marks."""
    _, fills = _matched(spark, d, "next_open_after_eligibility")
    costed = ex.execution_costs(ex.with_scenarios(fills, ("base", "stressed")))
    b = tt.bars(spark, d)
    marks = b.select("instrument_id", F.col("available_at").alias("at"), F.col("close").alias("price"))
    return costed, marks


def _curve(spark, d):
    fills, marks = _book(spark, d)
    curve = ledger.equity_curve(
        fills, marks, initial_cash=5_000_000.0, run=["scenario"],
        fill_order=["fill_at", "order_id", "fill_no"],
    )
    return fills, staged(curve, "curve")


@query(3)
def ledger_equity_curve(spark, d):
    return _curve(spark, d)[1]


def _pnl_curve(spark, d):
    fills, marks = _book(spark, d)
    return staged(
        ledger.equity_curve(
            fills, marks, initial_cash=5_000_000.0, run=["scenario"],
            fill_order=["fill_at", "order_id", "fill_no"], pnl=True,
        ), "curve",
    )


@query(3)
def ledger_pnl_curve(spark, d):
    return _pnl_curve(spark, d).select("scenario", "at", "equity", "realized_pnl", "unrealized_pnl")


@query(3)
def ledger_reconcile(spark, d):
    """Instants checked against the accounting identity, and how many break it."""
    curve = _pnl_curve(spark, d)
    broken = ledger.reconcile(curve, initial_cash=5_000_000.0)
    instants = curve.groupBy("scenario").agg(F.count(F.lit(1)).alias("instants"))
    bad = broken.groupBy("scenario").agg(F.count(F.lit(1)).alias("violations"))
    return instants.join(bad, "scenario", "left").fillna(0)


@query()
def ledger_stale_spans(spark, d):
    """Parts marked once a quarter at most, on a book valued on every day with a fill."""
    f = tt.fills(spark, d)
    held = ledger.positions(f, order=ORDERING, width=90 * DAY)
    marks = f.select("instrument_id", floor_time("fill_at", 90 * DAY).alias("at")).distinct()
    spans = ledger.stale_spans(
        held, marks, f.select(F.col("fill_at").alias("at")), limit=60 * DAY, order=ORDERING, width=90 * DAY
    )
    return spans.select("instrument_id", "mark_at", "first_at", "occurrences")


@query()
def ledger_stale_marks(spark, d):
    """Positions per part, marked by the last order day of its supplier's key space."""
    f = tt.fills(spark, d)
    held = ledger.positions(f, order=ORDERING, width=90 * DAY)
    marks = f.groupBy("instrument_id", floor_time("fill_at", 90 * DAY).alias("at")).agg(
        F.max("price").alias("price")
    )
    stale = ledger.stale_marks(held, marks, at="fill_at", limit=60 * DAY)
    return stale.select("instrument_id", *ORDERING, "mark_at", "age_us")


@query()
def ledger_short_positions(spark, d):
    held = ledger.positions(tt.fills(spark, d), order=ORDERING, width=90 * DAY)
    warned = ledger.short_positions(held).select(
        F.lit("short_position").alias("code"), "instrument_id", F.col("fill_at").alias("at"),
        F.lit(1).alias("occurrences"),
    )
    return ledger.warning_counts(warned)


def _trades(spark, d):
    """Stored trades: reports over them read them more than once."""
    return staged(_trade_rows(spark, d), "trades")


def _trade_rows(spark, d):
    f = tt.fills(spark, d)
    last = ledger.last_marks(f.select("instrument_id", F.col("fill_at").alias("at"), F.lit(1000.0).alias("price")))
    return ledger.trades(f, order=ORDERING, marks=last, width=90 * DAY)


@query(4)
def ledger_flat_to_flat_trades(spark, d):
    t = _trade_rows(spark, d)
    return t.withColumn("is_open", F.col("is_open").cast("int"))


@query(2)
def trade_statistics(spark, d):
    t = _trades(spark, d).withColumn("book", F.pmod(F.col("instrument_id").cast("bigint"), F.lit(8)))
    return metrics.trade_statistics(t, ["book"])


# -- metrics and runs ------------------------------------------------------------------------


def _performance(spark, d):
    fills, curve = _curve(spark, d)
    orders, _ = _orders(spark, d)
    listed = orders.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("stressed"))))
    return metrics.performance(
        curve, keys=["scenario"], bar_size="1h",
        annualization=metrics.annualization_for("24x7:1", "1h"), fills=fills, orders=listed,
    )


@query()
def metrics_performance(spark, d):
    """Money in cents: the sixth decimal of a large account is beyond what a double's sum holds."""
    return rounded(_performance(spark, d), 2, ["start_equity", "end_equity", "total_costs"])


@query(3)
def metrics_with_trades(spark, d):
    """A scenario's metric row with the statistics of its flat-to-flat trades."""
    fills, marks = _book(spark, d)
    fills = staged(fills, "fills")
    order, key = ["fill_at", "order_id", "fill_no"], ["scenario", "instrument_id"]
    curve = staged(ledger.equity_curve(fills, marks, initial_cash=5_000_000.0, run=["scenario"], fill_order=order), "curve")
    both = F.explode(F.array(F.lit("base"), F.lit("stressed"))).alias("scenario")
    last = ledger.last_marks(marks).select("*", both)
    trades = ledger.trades(fills, keys=key, order=order, marks=last)
    m = metrics.performance(
        curve, keys=["scenario"], bar_size="1h",
        annualization=metrics.annualization_for("24x7:1", "1h"), fills=fills, trades=staged(trades, "trades"),
    )
    return m.select("scenario", "total_return", "fill_count", *[c for c in m.columns if c.startswith("trades_")])


@query()
def metrics_drawdown(spark, d):
    _, curve = _curve(spark, d)
    periods = periodic_equity(curve.select("scenario", "at", "equity"), keys=["scenario"], bar_size="1h")
    out = metrics.period_path(periods, keys=["scenario"])
    return out.select("scenario", "period", "peak_at", "drawdown", "under_water_us")


@query()
def report_series(spark, d):
    _, curve = _curve(spark, d)
    return runs.report_series(curve, keys=["scenario"], bar_size="1h")


@query(2)
def metrics_cost_split(spark, d):
    f = tt.fills(spark, d).withColumn("year", F.year("fill_at"))
    return metrics.cost_split(f, ["year", "side"])


def _role_metrics(spark, d):
    """Metrics per run (priority) and role from yearly fold curves."""
    o = tt.load(spark, d, "orders")
    role = F.when(F.year("o_orderdate") % 2 == 0, "validation").otherwise("test")
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey"))
    curve = o.select(
        F.col("o_orderpriority").alias("run_id"), role.alias("role"), at.alias("at"),
        (F.col("o_totalprice") / 1000 + 1000).alias("equity"),
        (F.col("o_totalprice") / 2000).alias("gross_exposure"),
        (F.col("o_totalprice") / 4000).alias("net_exposure"),
    )
    return metrics.performance(
        curve, keys=["run_id", "role"], bar_size="1d",
        annualization=metrics.annualization_for("XNYS:1", "1d"),
    )


@query()
def metrics_by_role(spark, d):
    return _role_metrics(spark, d).select(
        "run_id", "role", "periods", "start_equity", "end_equity", "total_return",
        "annualized_volatility", "sharpe", "max_drawdown", "avg_gross_exposure", "period_hit_rate",
    )


def _identity(spark, d):
    o = tt.load(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.count_distinct("o_custkey").alias("instrument_count"), F.min("o_orderdate").alias("started_at")
    )


@query()
def run_table_pivot(spark, d):
    return runs.run_table(
        _identity(spark, d), _role_metrics(spark, d), columns=["total_return", "sharpe", "periods"]
    )


@query()
def run_fold_table(spark, d):
    """Metrics per run, fold and role, with the fold's range from the fold table."""
    o = tt.load(spark, d, "orders")
    fold = F.year("o_orderdate") - 1992
    role = F.when(fold % 2 == 0, "validation").otherwise("test")
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey"))
    curve = o.select(
        F.col("o_orderpriority").alias("run_id"), fold.alias("fold"), role.alias("role"), at.alias("at"),
        (F.col("o_totalprice") / 1000 + 1000).alias("equity"),
        (F.col("o_totalprice") / 2000).alias("gross_exposure"),
        (F.col("o_totalprice") / 4000).alias("net_exposure"),
    )
    m = metrics.performance(
        curve, keys=["run_id", "fold", "role"], bar_size="1d",
        annualization=metrics.annualization_for("XNYS:1", "1d"),
    )
    begins = F.date_trunc("year", "o_orderdate")
    folds = o.select(
        fold.alias("fold"), role.alias("role"), begins.alias("start"), F.date_trunc("year", shift(begins, 370 * DAY)).alias("end")
    ).distinct()
    return runs.fold_table(m, folds).select("run_id", "fold", "role", "start", "end", "periods", "total_return", "max_drawdown")


@query()
def run_compare(spark, d):
    table = runs.run_table(
        _identity(spark, d), _role_metrics(spark, d), columns=["total_return", "max_drawdown"]
    )
    return runs.compare(table, role="test")


@query()
def run_agreement(spark, d):
    m = staged(_role_metrics(spark, d), "metrics")
    columns = ["total_return", "sharpe", "periods"]
    a = m.where("role = 'validation'").select("run_id", *columns)
    b = m.where("role = 'test'").select(
        "run_id", "total_return", "sharpe", F.col("periods").cast("double").alias("periods")
    )
    same = m.where("role = 'validation'").select(
        "run_id", (F.col("total_return") * (1 + 1e-12)).alias("total_return"), "sharpe",
        F.lit(None).cast("double").alias("periods"),
    )
    first = runs.agreement(a, b, on=["run_id"], columns=columns).withColumn("pair", F.lit("roles"))
    second = runs.agreement(a, same, on=["run_id"], columns=columns).withColumn("pair", F.lit("copy"))
    return first.unionByName(second)


@query(4)
def report_top_bottom_trades(spark, d):
    picked = runs.best_and_worst(_trades(spark, d), k=5, tiebreak=["instrument_id", "trade_no"])
    return picked.select("instrument_id", "trade_no", "direction", "opened_at", "net_pnl")


@query(4)
def series_downsample(spark, d):
    f = tt.load(spark, d, "orders")
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey"))
    series = f.select("o_orderpriority", at.alias("at"), F.col("o_totalprice").alias("value"))
    return metrics.downsample(
        series, at="at", value="value", limit=200, keys=["o_orderpriority"], width=90 * DAY
    )


@query(4)
def histogram_pnl(spark, d):
    closed = _trades(spark, d).where(~F.col("is_open"))
    return metrics.histogram(closed, "net_pnl")


@query()
def fold_preview(spark, d):
    return runs.preview(_folds(spark, d), scenarios=8, fill_rules=2, trials=3)


# -- whole pipelines -------------------------------------------------------------------------


def _sweep(spark, d, axes, setup):
    b = staged(tt.bars(spark, d), "bars")
    made = compute_features(b, [ft.lagged_return(1), ft.rolling_volatility(5)], bar_size="1h")
    folds = splits.walk_forward(_span_of(b), PLAN)
    signal = runs.with_grid(made.where(F.col("ret_1").isNotNull()), axes).select(
        "trial", "instrument_id", F.col("available_at").alias("decision_at"), "bar_start",
        F.when(F.col("ret_1") > F.col("threshold"), F.col("weight")).otherwise(0.0).alias("target"),
    )
    return bt.backtest(
        signal, b, folds, setup, run=["trial"], roles=("validation", "test"),
        accounts=runs.with_grid(folds.select("fold", "role"), axes),
    )


def _axis(name: str, values) -> list[F.Column]:
    return [F.struct(F.lit(v).alias(name)) for v in values]


BOOK = bt.Setup(
    bar_size="1h", execution=ex.Execution(expire_after="6h", liquidity_lookback=5)
)


@query(4)
def backtest_open_loop(spark, d):
    single = bt.Setup(
        bar_size="1h", execution=BOOK.execution, scenarios=("base",),
        fill_rules=("next_open_after_eligibility",),
    )
    m = _sweep(spark, d, [_axis("threshold", [0.0]), _axis("weight", [0.2])], single)["metrics"]
    # Two days annualised run from -1 to 1e17; the logarithm has digits that mean something.
    growth = F.ln(F.try_divide(F.col("end_equity"), F.col("start_equity"))) * F.col("periods_per_year")
    growth = F.try_divide(growth, F.col("periods")).alias("annualized_log_growth")
    return m.select(*[growth if c == "annualized_return" else c for c in m.columns])


def _ended(spark, d, policy: str) -> dict[str, DataFrame]:
    """The signal's orders and fills, account by account, under an end-of-range policy."""
    setup = bt.Setup(
        bar_size="1h", execution=BOOK.execution, scenarios=("base",),
        fill_rules=("next_open_after_eligibility",), end_of_range=policy,
    )
    return _sweep(spark, d, [_axis("threshold", [0.0]), _axis("weight", [0.2])], setup)


def _end_report(made: dict[str, DataFrame]) -> DataFrame:
    """Per fold and role: fills, cancelled orders, open positions, and the money there is."""
    key = ["fold", "role"]
    money = -ledger.signed_quantity() * F.col("price") - F.col("fee")
    fills = made["fills"].groupBy(*key).agg(
        F.count(F.lit(1)).alias("fills"), F.count_if("liquidation").alias("liquidation_fills"),
        (F.sum(money) + 100_000.0).alias("cash"),
    )
    cancelled = made["events"].groupBy(*key).agg(F.count_if(F.col("status") == "cancelled").alias("cancelled"))
    held = made["positions"].groupBy(*key).agg(F.count(F.lit(1)).alias("open_positions"), F.sum("value").alias("value"))
    found = made["findings"].groupBy(*key).agg(F.count(F.lit(1)).alias("findings"))
    out = fills
    for other in (cancelled, held, found):
        out = out.join(other, key, "left")
    return out.fillna(0)


@query(4)
def backtest_end_mark(spark, d):
    return _end_report(_ended(spark, d, "mark"))


@query(4)
def backtest_end_liquidate(spark, d):
    return _end_report(_ended(spark, d, "liquidate"))


@query(4)
def sweep_parameter_grid(spark, d):
    axes = [_axis("threshold", [0.0, 0.5, 1.0]), _axis("weight", [0.1, 0.2])]
    m = _sweep(spark, d, axes, BOOK)["metrics"]
    mean = m.groupBy("trial", "fill_rule", "scenario", "role").agg(
        F.avg("total_return").alias("total_return"), F.sum("fill_count").alias("fill_count")
    )
    wide = mean.groupBy("trial", "fill_rule", "scenario").pivot("role", ["validation", "test"]).agg(
        F.first("total_return").alias("total_return"), F.first("fill_count").alias("fill_count")
    )
    return runs.rank_trials(wide)


# -- streaming -------------------------------------------------------------------------------


def _stream(spark, d):
    prepare(spark)
    raw = spark.read.parquet(os.path.join(d, "events.parquet")).schema
    stream = (
        spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(d)
    )
    return stream.withColumns(
        {"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("bigint")}
    )


def _drain(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its Parquet output back."""
    base = scratch(spark, "stream")
    done = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows")
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query()
def stream_closed_bars(spark, d):
    made = streaming.stream_bars(
        _stream(spark, d), instrument="event_type", at="ts", price="value", quantity="k",
        tiebreak="event_id", bar_size="1h", latency="2s",
    )
    return _drain(spark, made)


@query()
def stream_deduplicated_users(spark, d):
    keyed = _stream(spark, d).select(
        F.col("event_type").alias("instrument_id"), F.lit("1m").alias("bar_size"),
        floor_time("ts", "1h").alias("bar_start"), F.lit(0).alias("revision"),
    )
    made = _drain(spark, streaming.stream_deduplicated(keyed, delay="40d"))
    return made.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def stream_findings(spark, d):
    b = streaming.stream_bars(
        _stream(spark, d), instrument="event_type", at="ts", price="value", quantity="k",
        tiebreak="event_id", bar_size="1h", latency="2s",
    )
    base = scratch(spark, "stream")
    done = (
        b.writeStream.foreachBatch(streaming.findings_sink(f"{base}/found", "1s"))
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    found = spark.read.parquet(f"{base}/found")
    return found.groupBy("check", "severity").agg(F.sum("occurrences").alias("occurrences"))


def _arriving(rows: DataFrame, at: str, late_by: F.Column, name: str) -> tuple[str, DataFrame]:
    """Rows stored in files in the order they arrive, each file five days of arrivals."""
    folder = scratch(rows.sparkSession, name)
    day = bucket_of(F.unix_micros(at) + late_by, 5 * DAY)
    placed = staged(rows.withColumn("__arrival", day), name)
    for (number,) in placed.select("__arrival").distinct().orderBy("__arrival").collect():
        mine = placed.where(F.col("__arrival") == number).drop("__arrival")
        mine.coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


@query()
def stream_late_rows(spark, d):
    """Events that arrive up to 36 hours late, kept or told apart at a watermark of 12 hours."""
    events = tt.load(spark, d, "events").select("event_id", "event_type", "ts")
    folder, _ = _arriving(events, "ts", F.pmod("event_id", F.lit(7)) * (6 * HOUR), "arrivals")
    base = scratch(spark, "late")
    done = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        .writeStream.foreachBatch(streaming.late_rows_sink(base, at="ts", bar_size="1h", latency="12h"))
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    counts = [
        spark.read.schema(events.schema).parquet(f"{base}/{side}").groupBy("event_type").agg(F.count(F.lit(1)).alias(side))
        for side in ("kept", "late")
    ]
    return counts[0].join(counts[1], "event_type", "full").fillna(0)


@query()
def stream_availability_order(spark, d):
    """Bars that arrive out of order, compared with their predecessors once the watermark passes."""
    kept = ["instrument_id", "bar_start", "revision", "available_at"]
    b = tt.bars(spark, d).select(*kept)
    folder, _ = _arriving(b, "bar_start", F.pmod(hour_of(), F.lit(7)) * (3 * HOUR), "arrivals")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return _drain(spark, streaming.stream_out_of_order(stream, delay="2d", forget="20d"))
