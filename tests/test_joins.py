import random

import pytest
from pyspark.sql import functions as F

from instants import at, rows_of
from pitbars.operators import joins
from pitbars.operators.joins import asof_join, containing_bar, first_open_after, interval_join, late_matches

LEFT = "instrument_id STRING, cutoff TIMESTAMP, n INT"
RIGHT = "instrument_id STRING, available_at TIMESTAMP, value DOUBLE"


def left(spark, *rows):
    return spark.createDataFrame(list(rows), LEFT)


def right(spark, *rows):
    return spark.createDataFrame(list(rows), RIGHT)


def test_equality_is_visible_and_a_microsecond_late_is_not(spark):
    r = right(spark, ("X", at(5), 1.0), ("X", at(5, 1e-6), 2.0))
    got = asof_join(left(spark, ("X", at(5), 1), ("X", at(5, 1e-6), 2)), r, as_of="cutoff")
    assert [x[4] for x in rows_of(got, "n")] == [1.0, 2.0]
    assert late_matches(got, as_of="cutoff").count() == 0


def test_no_match_and_key_isolation(spark):
    r = right(spark, ("X", at(5), 1.0), ("Y", at(1), 9.0))
    got = asof_join(left(spark, ("X", at(4), 1), ("Z", at(9), 2), (None, at(9), 3)), r, as_of="cutoff")
    assert [x[4] for x in rows_of(got, "n")] == [None, None, None]


def test_match_carried_over_many_empty_buckets(spark):
    r = right(spark, ("X", at(0), 1.0))
    got = asof_join(left(spark, ("X", at(60 * 24 * 40), 1)), r, as_of="cutoff")
    assert rows_of(got)[0][4] == 1.0


def test_staleness_is_inclusive(spark):
    r = right(spark, ("X", at(0), 1.0))
    l = left(spark, ("X", at(5), 1), ("X", at(5, 1e-6), 2))
    got = asof_join(l, r, as_of="cutoff", max_staleness="5m")
    assert [x[4] for x in rows_of(got, "n")] == [1.0, None]


def test_null_payload_still_matches(spark):
    r = right(spark, ("X", at(0), 1.0), ("X", at(1), None))
    got = asof_join(left(spark, ("X", at(2), 1)), r, as_of="cutoff", prefix="r_")
    assert rows_of(got)[0][3:] == (at(1), None)


def test_ties_do_not_depend_on_row_order(spark):
    rows = [("X", at(0), float(v)) for v in range(20)]
    for seed in (1, 2, 3):
        r = right(spark, *rows).orderBy(F.rand(seed)).repartition(5)
        assert rows_of(asof_join(left(spark, ("X", at(1), 1)), r, as_of="cutoff"))[0][4] == 19.0


def test_refusals(spark):
    r = right(spark, ("X", at(0), 1.0))
    with pytest.raises(ValueError, match="available_at"):
        asof_join(left(spark, ("X", at(0), 1)), r.drop("available_at"), as_of="cutoff")
    with pytest.raises(ValueError, match="collide"):
        asof_join(left(spark, ("X", at(0), 1)).withColumn("value", F.lit(1)), r, as_of="cutoff")


def test_next_open_and_containing_bar(spark, make_bars):
    opens = make_bars([10, 11, 12, 13], skip=(2,)).select("instrument_id", "bar_start", "open")
    rows = left(spark, ("X", at(1), 1), ("X", at(1, 30), 2), ("X", at(2, 30), 3), ("X", at(9), 4))
    ahead = first_open_after(rows, opens, at="cutoff").select("n", "next_open.open")
    assert rows_of(ahead, "n") == [(1, 11.0), (2, 13.0), (3, 13.0), (4, None)]
    inside = containing_bar(rows, opens, at="cutoff", step="1m").select("n", "containing.open")
    assert rows_of(inside, "n") == [(1, 11.0), (2, 11.0), (3, None), (4, None)]


def test_interval_join_is_half_open_across_buckets(spark):
    points = left(spark, ("X", at(0), 1), ("X", at(60 * 50), 2), ("X", at(60 * 72), 3))
    spans = spark.createDataFrame([("a", at(0), at(60 * 72))], "name STRING, start TIMESTAMP, end TIMESTAMP")
    got = interval_join(points, spans, at="cutoff", how="left").select("n", "name")
    assert rows_of(got, "n") == [(1, "a"), (2, "a"), (3, None)]


def test_overlapping_ranges_meet_once(spark):
    rng = random.Random(2)

    def made(n):
        starts = [rng.randrange(-2000, 2000) for _ in range(n)]
        return [(i, i % 3, at(s), at(s + rng.choice([0, 1, 30, 1500]))) for i, s in enumerate(starts)]

    a, b = made(60), made(70)
    kind = "id INT, k INT, start TIMESTAMP, end TIMESTAMP"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    for by in ([], ["k"]):
        met = joins.overlap_join(left, right, by=by, width="4h")
        assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
        expected = sorted((x[0], y[0]) for x in a for y in b
                          if (not by or x[1] == y[1]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
        assert rows_of(met.select("id", "right_id"), "id", "right_id") == expected
    few = joins.overlap_join(left, right, condition=F.col("right_id") < F.col("id"))
    assert few.where("right_id >= id").isEmpty() and not few.isEmpty()


def test_points_outside_all_ranges(spark):
    points = spark.createDataFrame([(m, at(m)) for m in range(0, 4000, 7)], "m INT, at TIMESTAMP")
    spans = [(100, 130), (1400, 3000), (500, 500)]
    table = spark.createDataFrame([(at(a), at(b)) for a, b in spans], "start TIMESTAMP, end TIMESTAMP")
    kept = joins.outside_ranges(points, table, at="at")
    assert rows_of(kept.select("m"), "m") == [(m,) for m in range(0, 4000, 7) if not any(a <= m < b for a, b in spans)]
