"""Sources, normalisation, quality, calendars, catalog, ledgers."""

import datetime as dt
import glob
import gzip

import pytest
from pyspark.sql import functions as F

from instants import at, rows_of
from pitbars.operators import calendars as cal
from pitbars.operators import normalize, quality
from pitbars.operators.resample import latest_revisions, resample
from pitbars.plans.ingest import derive, ingest
from pitbars.sources.catalog import BarCatalog, dataset_id, point_in_time
from pitbars.sources.files import Source, read_bars, strict_utc
from pitbars.sources.klines import parse_klines
from pitbars.sources.ledgers import LedgerStore, write_features
from pitbars.types import format_micros, micros, utc

UTC = dt.timezone.utc


def test_durations_have_one_spelling():
    assert micros("5m") == 300_000_000 and format_micros(micros("3600s")) == "1h"
    for bad in ("0m", "5", "5min", "-1h", "1.5h"):
        with pytest.raises(ValueError):
            micros(bad)
    with pytest.raises(ValueError):
        utc(dt.datetime(2024, 1, 1))


def aliases(spark):
    return spark.createDataFrame(
        [("id1", "OLD", "s", at(0), at(2)), ("id1", "NEW", "s", at(2), None), ("id2", "B", "s", at(0), None)],
        "instrument_id STRING, symbol STRING, source STRING, effective_from TIMESTAMP, effective_to TIMESTAMP",
    )


CSV = """timestamp,symbol,open,high,low,close,volume,trades
2024-03-04T00:00:00Z,OLD,1,2,0.5,1.5,10,3
2024-03-04T00:01:00Z,OLD,1,2,0.5,1.5,10,3
2024-03-04T02:02:00+02:00,NEW,1,2,0.5,1.5,10,3
2024-03-04T00:02:00Z,OLD,1,2,0.5,1.5,10,3
2024-03-04T00:00:00Z,ZZZ,1,2,0.5,1.5,10,3
"""


@pytest.mark.parametrize("suffix", ["csv", "csv.gz"])
def test_csv_source_with_symbol_change_and_unmapped_rows(spark, tmp_path, suffix):
    path = tmp_path / f"bars.{suffix}"
    opener = gzip.open if suffix.endswith("gz") else open
    with opener(path, "wt") as f:
        f.write(CSV)
    bars, unmapped = read_bars(
        spark, str(path), aliases=aliases(spark), bar_size="1m", label="bar_start", latency="2s",
        source="s", mapping={"trade_count": "trades"},
    )
    got = rows_of(bars.select("instrument_id", "bar_start", "available_at", "trade_count"), "bar_start")
    assert got == [("id1", at(i), at(i + 1, 2), 3) for i in range(3)]
    assert sorted(rows_of(unmapped)) == [("OLD", 1), ("ZZZ", 1)]


def test_many_sources_of_mixed_formats(spark, tmp_path):
    lines = CSV.splitlines()
    (tmp_path / "day").mkdir()
    (tmp_path / "day" / "a.txt").write_text("\n".join(lines[:2]) + "\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("\n".join([lines[0], lines[2]]) + "\n")
    typed = spark.createDataFrame([(at(2), "NEW", 1.0, 2.0, 0.5, 1.5, 10.0, 3)], "timestamp TIMESTAMP, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trades BIGINT")
    typed.coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    bars, _ = read_bars(
        spark, [Source(str(tmp_path / "day"), "csv", revision=2), str(tmp_path / "b.csv.gz"), Source(str(tmp_path / "c.parquet"), revision=1)],
        aliases=aliases(spark), bar_size="1m", label="bar_start", latency="2s", source="s",
        mapping={"trade_count": "trades"}, keep_file=True,
    )
    got = rows_of(bars.select("bar_start", "revision", "trade_count", "close", "source_key"), "bar_start")
    assert [r[:4] for r in got] == [(at(0), 2, 3, 1.5), (at(1), 0, 3, 1.5), (at(2), 1, 3, 1.5)]
    assert [r[4] for r in got][:2] == ["a.txt", "b.csv.gz"]


def test_source_refusals(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text(CSV.replace("00:01:00Z", "00:01:00"))
    args = dict(aliases=aliases(spark), bar_size="1m", label="bar_start", latency="2s", source="s")
    bars, _ = read_bars(spark, str(path), **args)
    with pytest.raises(Exception, match="no UTC offset"):
        bars.collect()
    with pytest.raises(ValueError, match=r"lacks \['close \(c\)', 'vwap \(vw\)'\].*'vol'"):
        read_bars(spark, str(path), mapping={"vwap": "vw", "close": "c", "vol": "x"}, **args)
    with pytest.raises(ValueError, match="unsupported"):
        read_bars(spark, "x.json", **args)
    naive = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t")
    with pytest.raises(ValueError, match="no time zone"):
        strict_utc(naive, "t")


def test_labels_move_both_edges(spark):
    df = spark.createDataFrame([(at(5),)], "t TIMESTAMP")
    end = normalize.bar_bounds(df, at="t", label="bar_end", bar_size="5m")
    assert rows_of(end.select("bar_start", "bar_end")) == [(at(0), at(5))]
    with pytest.raises(ValueError):
        normalize.bar_bounds(df, at="t", label="close", bar_size="5m")


def test_alias_overlap_is_found_within_and_across_instruments(spark):
    extra = spark.createDataFrame([("id3", "B", "s", at(9), None)], aliases(spark).schema)
    both = aliases(spark).unionByName(extra)
    assert normalize.alias_overlaps(aliases(spark)).count() == 0
    assert normalize.alias_overlaps(both, keys=("source", "symbol")).count() == 1


def test_duplicate_policies(make_bars):
    two = make_bars([1, 2]).unionByName(make_bars([5], revision=1, late={0: 3}))
    with pytest.raises(ValueError, match="duplicate"):
        normalize.apply_duplicate_policy(two, "error")
    high = normalize.apply_duplicate_policy(two, "keep_highest_revision")
    first = normalize.apply_duplicate_policy(two, "keep_first")
    assert [r.close for r in high.orderBy("bar_start").collect()] == [5.0, 2.0]
    assert [r.close for r in first.orderBy("bar_start").collect()] == [1.0, 2.0]


KLINES = (
    '[[1709510400000,"1","3","0.5","2","10",1709510459999,"15",7,"0","0","0"],'
    '[1709510460000,"2","3","2","2","0",1709510519999,"0",0,"0","0","0"],'
    '[1709510460000,"2","3","2","2","0",1709510519999,"0",0,"0","0","0"],'
    '[1709510520000,"2","3","2","2","1",1709510579999,"2",1,"0","0","0"]]'
)


def test_klines(spark):
    docs = spark.createDataFrame([("X", KLINES)], "i STRING, j STRING")
    args = dict(instrument="i", json="j", bar_size="1m", latency="2s", source="k")
    got = parse_klines(docs, closed_before=at(2, 30), **args).orderBy("bar_start").collect()
    assert [(r.vwap, r.trade_count, r.source_key) for r in got] == [
        (1.5, 7, "X:1709510400000"), (None, 0, "X:1709510460000"),
    ]
    with pytest.raises(Exception, match="does not fit"):
        parse_klines(docs, **{**args, "bar_size": "5m"}).collect()
    with pytest.raises(ValueError):
        parse_klines(docs, label="bar_end", **args)


def test_findings(spark, make_bars):
    bars = make_bars([10, 11, 12, 13, 14, 15], skip=(2, 3), late={0: 5})
    broken = bars.withColumn("volume", F.when(F.col("bar_start") == F.lit(at(5)), 0.0).otherwise(F.col("volume")))
    found = {r["check"]: r for r in quality.validate(broken, bar_size="1m", latency="2s", expect_grid=True).collect()}
    assert set(found) == {
        "row_count", "zero_volume_bar", "availability_out_of_order", "publication_latency_mismatch", "missing_bars",
    }
    gap = found["missing_bars"]
    assert gap.occurrences == 2 and gap.instrument_id == "X" and gap.sample[0] == "2024-03-04 00:02:00"
    assert found["row_count"].occurrences == 4
    empty = quality.validate(bars.limit(0), bar_size="1m", latency="2s")
    assert [r["check"] for r in empty.collect()] == ["empty_dataset"]
    quality.refuse_on_error(quality.validate(broken, bar_size="1m", latency="2s"))
    with pytest.raises(ValueError, match="refused"):
        quality.refuse_on_error(empty)


def test_contract_rules_hold_for_sound_bars_only(make_bars):
    bars = make_bars([10, 11])
    assert normalize.contract_violations(bars).count() == 0
    bad = bars.withColumn("high", F.lit(float("nan"))).withColumn("revision", F.lit(-1))
    rules = {r.rule for r in normalize.contract_violations(bad).collect()}
    assert {"finite_prices", "revision_not_negative"} <= rules


# Published full closures and early closes of the New York exchange.
CLOSED = {
    2020: "01-01 01-20 02-17 04-10 05-25 07-03 09-07 11-26 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24",
    2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26",
    2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
    2025: "01-01 01-09 01-20 02-17 04-18 05-26 06-19 07-04 09-01 11-27 12-25",
}
EARLY = {2020: "11-27 12-24", 2023: "07-03 11-24", 2024: "07-03 11-29 12-24", 2025: "07-03 11-28 12-24"}


def test_new_york_calendar(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2025-12-31')) AS session_date")
    sessions = cal.xnys_sessions(days).collect()
    open_days = {r.session_date for r in sessions}
    for year, listed in CLOSED.items():
        weekdays = {d for d in (dt.date(year, 1, 1) + dt.timedelta(i) for i in range(366))
                    if d.year == year and d.weekday() < 5}
        assert {d.strftime("%m-%d") for d in weekdays - open_days} == set(listed.split()), year
    for year, listed in EARLY.items():
        got = {r.session_date.strftime("%m-%d") for r in sessions if r.early_close and r.session_date.year == year}
        assert got == set(listed.split()), year
    by_day = {r.session_date: r for r in sessions}
    summer, winter = by_day[dt.date(2024, 7, 1)], by_day[dt.date(2024, 1, 3)]
    assert summer.session_open.astimezone(UTC).hour == 13 and winter.session_open.astimezone(UTC).hour == 14


def test_grid_check_can_follow_sessions(spark, make_bars):
    bars = make_bars([1] * 6, skip=(3,))
    sessions = spark.createDataFrame(
        [(dt.date(2024, 3, 4), at(0), at(3), False)],
        "session_date DATE, session_open TIMESTAMP, session_close TIMESTAMP, early_close BOOLEAN",
    )
    assert quality.missing_intervals(bars, "1m").count() == 1
    assert quality.missing_intervals(bars, "1m", sessions).count() == 0


def test_resample_clamps_availability_and_leaves_vwap_null(make_bars):
    bars = make_bars([10, 12, 11, 14, 13, 20], late={1: 9}).withColumn("vwap", F.lit(None).cast("double"))
    got = resample(bars, source_size="1m", target_size="5m").orderBy("bar_start").collect()
    first, second = got
    assert (first.open, first.close, first.high, first.low, first.volume) == (10, 13, 15, 9, 500)
    assert first.vwap is None
    assert first.available_at.astimezone(UTC) == at(11, 2), "the slowest input decides"
    assert second.available_at.astimezone(UTC) == at(10), "an incomplete window waits for its end"
    with pytest.raises(ValueError):
        resample(bars, source_size="1m", target_size="90s")


def test_revisions_are_seen_as_they_were_known(make_bars):
    bars = make_bars([1, 2, 3]).unionByName(make_bars([9], revision=1, late={0: 30}))
    early = point_in_time(bars, as_of=at(10)).orderBy("bar_start").collect()
    late = point_in_time(bars, as_of=at(60)).orderBy("bar_start").collect()
    assert [r.close for r in early] == [1, 2, 3] and [r.close for r in late] == [9, 2, 3]
    assert latest_revisions(bars).count() == 3


def test_catalog_round_trip(spark, make_bars, tmp_path):
    catalog = BarCatalog(spark, str(tmp_path / "root"))
    bars = make_bars(range(10, 3009), inst="X").unionByName(make_bars(range(5, 20), inst="Y"))
    dataset, existed, findings = ingest(
        catalog, bars, {"source": "t"}, bar_size="1m", latency="2s", duplicates="error"
    )
    assert not existed and findings.where("severity = 'error'").count() == 0
    again, existed, _ = ingest(
        catalog, bars.orderBy(F.rand(1)).repartition(5), {"source": "t"}, bar_size="1m", latency="2s"
    )
    assert existed and again == dataset == dataset_id({"source": "t", "bar_size": "1m"})
    with pytest.raises(ValueError, match="other content"):
        catalog.write(bars.limit(3), {"source": "t", "bar_size": "1m"})

    days = catalog.selected_dates(dataset, as_of=at(60 * 24 * 9), start=at(60 * 30), instruments=["Y"])
    assert days == [], "Y only trades on the first day"
    got = catalog.scan(dataset, as_of=at(10), instruments=["X"], columns=["bar_start", "close"])
    expected = point_in_time(bars, as_of=at(10), instruments=["X"], columns=["bar_start", "close"])
    assert rows_of(got, "bar_start") == rows_of(expected, "bar_start")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "available_at" in plan.split("PushedFilters")[1]

    sql = catalog.query_asof(dataset, at(10), where="volume > 0")
    assert sql.count() == catalog.scan(dataset, as_of=at(10), revisions="all").count()
    assert {"datasets", "dataset_partitions", f"bars_{dataset}"} <= set(catalog.register([dataset]))
    with pytest.raises(ValueError):
        catalog.scan_unfiltered(dataset, reason="why")

    coarse, _ = derive(catalog, dataset, source_size="1m", target_size="1h")
    assert catalog.describe(coarse)["bar_size"] == "1h"
    assert catalog.verify(dataset).count() == 0
    stray = glob.glob(str(tmp_path / f"root/bars/dataset={dataset}/date=2024-03-05/*.parquet"))[0]
    spark.read.parquet(stray).limit(5).write.mode("append").parquet(stray.rsplit("/", 1)[0])
    assert {r.part for r in catalog.verify(dataset).collect()} == {"2024-03-05", "content"}


def test_ledger_store_publishes_once(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "runs"))
    fills = spark.createDataFrame([(0, "test", "X", at(0), "buy", 1.0, 2.0, 0.1)],
        "fold INT, role STRING, instrument_id STRING, fill_at TIMESTAMP, side STRING, quantity DOUBLE, price DOUBLE, fee DOUBLE")
    curve = spark.createDataFrame([(0, "test", at(0), 1.0, 1.0)], "fold INT, role STRING, at TIMESTAMP, equity DOUBLE, cash DOUBLE")
    frames = {"fills": fills, "equity_curve": curve}
    store.publish("r1", frames, {"experiment_id": "e"})
    assert store.publish("r1", frames, {"experiment_id": "e"}) == store.describe("r1")["economic_digest"]
    with pytest.raises(ValueError):
        store.publish("r1", {**frames, "fills": fills.withColumn("fee", F.lit(9.0))}, {})
    assert store.load("fills").count() == 1 and store.by_experiment("e").count() == 1
    assert store.reproduces("r1", fills.repartition(3), curve)


def test_feature_sink_writes_its_specs(spark, make_bars, tmp_path):
    from pitbars.functions.features import lagged_return
    from pitbars.operators.features import compute_features

    spec = lagged_return(1)
    write_features(compute_features(make_bars([1, 2]), [spec], bar_size="1m"), [spec], str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/specs")).first().name == "ret_1"
    assert spark.read.parquet(str(tmp_path / "f/rows")).count() == 2
