import math

import pytest
from pyspark.sql import functions as F

from instants import at, rows_of
from pitbars.functions import features as ft
from pitbars.operators import leakage
from pitbars.operators.crosssection import CrossMean, CrossRank, cross_section
from pitbars.operators.features import compute_features


def column(df, name):
    return [r[name] for r in df.orderBy("instrument_id", "bar_start").collect()]


def test_values_by_hand(make_bars):
    bars = make_bars([100, 110, 99, 99])
    got = compute_features(
        bars, [ft.lagged_return(1), ft.rolling_volatility(2), ft.rolling_zscore(2), ft.rolling_range(2)],
        bar_size="1m",
    )
    assert column(got, "ret_1") == pytest.approx([None, 0.1, -0.1, 0.0])
    assert column(got, "vol_2")[2] == pytest.approx(math.sqrt(0.02))
    assert column(got, "zscore_2")[3] is None, "a flat window has no scale"
    assert column(got, "zscore_2")[1] == pytest.approx(5 / math.sqrt(50))
    assert column(got, "range_2")[1] == pytest.approx((111 - 99) / 110)


def test_gaps_null_values_but_not_rows(make_bars):
    got = compute_features(make_bars([1, 2, 3, 4, 5], skip=(2,)), [ft.lagged_return(1)], bar_size="1m")
    assert column(got, "ret_1") == [None, 1.0, None, 0.25]


def test_availability_is_that_of_the_slowest_input(make_bars):
    got = compute_features(make_bars([1, 2, 3, 4], late={1: 7}), [ft.lagged_return(2)], bar_size="1m")
    assert [r[1] for r in rows_of(got.select("bar_start", "available_at"), "bar_start")] == [
        at(1, 2), at(9, 2), at(9, 2), at(9, 2),
    ]


def test_relative_volume_excludes_the_current_bar(make_bars):
    bars = make_bars([1, 1, 1]).withColumn("volume", F.minute("bar_start") * 10.0)
    got = compute_features(bars, [ft.relative_volume(1)], bar_size="1m")
    assert column(got, "rvol_1") == [None, None, 2.0], "a zero norm gives no value"


def test_registry_and_refusals(make_bars):
    assert ft.build_feature("lagged_return", lag=3).name == "ret_3"
    with pytest.raises(KeyError):
        ft.build_feature("nope")
    with pytest.raises(ValueError):
        compute_features(make_bars([1]), [ft.lagged_return(1), ft.lagged_return(1)], bar_size="1m")
    with pytest.raises(Exception, match="unexpected bar_size"):
        compute_features(make_bars([1]), [ft.lagged_return(1)], bar_size="5m").collect()


@pytest.mark.parametrize("chunk", [3, None])
def test_row_order_and_chunks_do_not_matter(make_bars, chunk):
    bars = make_bars(range(10, 40), skip=(7, 8)).unionByName(make_bars(range(50, 60), inst="Y"))
    fs = [ft.lagged_return(2), ft.rolling_volatility(3), ft.relative_volume(2)]
    base = rows_of(compute_features(bars, fs, bar_size="1m"), "instrument_id", "bar_start")
    mixed = bars.orderBy(F.rand(5)).repartition(6)
    assert rows_of(compute_features(mixed, fs, bar_size="1m", chunk_rows=chunk), "instrument_id", "bar_start") == base


DATASETS = {
    "clean": {}, "gap": {"skip": (12, 13)}, "late": {"late": {9: 6}},
    "both": {"skip": (12, 13), "late": {9: 6, 20: 3}},
}
SETS = [ft.lagged_return(1), ft.lagged_return(3, "log"), ft.rolling_volatility(4), ft.relative_volume(3),
        ft.rolling_zscore(5), ft.rolling_range(4), ft.bar_range(), ft.minute_of_day()]


def keyed(fs):
    return lambda rows: compute_features(rows, fs, bar_size="1m", keys=["cut", "instrument_id"], chunk_rows=None)


@pytest.mark.parametrize("kind", DATASETS)
def test_features_do_not_read_the_future(make_bars, kind):
    bars = make_bars([100 + (i * 37) % 17 for i in range(40)], **DATASETS[kind])
    cuts = leakage.cut_points(bars)
    leakage.assert_no_leak(leakage.prefix_violations(bars, keyed(SETS), cuts))
    leakage.assert_no_leak(leakage.future_violations(bars, keyed(SETS), cuts))


def peek(value, name="peek", lookback=0):
    return ft.FeatureSpec(name, ("close",), lookback, value, contiguous=False, kind=name)


def test_dishonest_features_are_caught(make_bars):
    bars = make_bars([100 + (i * 37) % 17 for i in range(40)], late={9: 6})
    cuts = leakage.cut_points(bars)
    ahead = keyed([peek(lambda w: F.lead("close", 1).over(w))])
    assert leakage.prefix_violations(bars, ahead, cuts).count() > 0
    assert leakage.future_violations(bars, ahead, cuts).count() > 0
    # Understated lookback: the value needs the bar before, the declared availability does
    # not wait for it. Only a late bar tells.
    short = keyed([peek(lambda w: F.lag("close", 1).over(w))])
    late_cut = [at(12)]
    assert leakage.prefix_violations(bars, short, late_cut).count() > 0
    with pytest.raises(AssertionError):
        leakage.assert_no_leak(leakage.prefix_violations(bars, short, late_cut))


def frame(spark, values):
    rows = [(i, at(0), at(1, n), v) for n, (i, v) in enumerate(values)]
    return spark.createDataFrame(rows, "instrument_id STRING, bar_start TIMESTAMP, available_at TIMESTAMP, v DOUBLE")


def ranked(spark, values, **kw):
    got = cross_section(frame(spark, values), [CrossRank("v", **kw)])
    return {r.instrument_id: r.v_xrank for r in got.collect()}


def test_rank_methods(spark):
    values = [("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 500.0), ("e", None), ("f", -3.0)]
    expect = {
        "average": [2, 3.5, 3.5, 5, None, 1], "min": [2, 3, 3, 5, None, 1], "max": [2, 4, 4, 5, None, 1],
        "dense": [2, 3, 3, 4, None, 1], "ordinal": [2, 3, 4, 5, None, 1],
    }
    for method, ranks in expect.items():
        got = ranked(spark, values, method=method, pct=False)
        assert [got[k] for k in "abcdef"] == ranks, method
    down = ranked(spark, values, method="min", pct=False, descending=True)
    assert [down[k] for k in "abcdf"] == [4, 2, 2, 1, 5]
    assert ranked(spark, values)["d"] == 1.0


def test_too_few_members_give_null_and_batches_wait(spark):
    assert ranked(spark, [("a", 1.0), ("b", None)]) == {"a": None, "b": None}
    got = cross_section(frame(spark, [("a", 1.0), ("b", 3.0), ("c", None)]), [CrossMean("v")])
    assert {r.v_xmean for r in got.collect()} == {2.0}
    assert len({r.available_at for r in got.collect()}) == 1
