import pytest
from pyspark.sql import functions as F

from instants import T0, at, rows_of
from pitbars.operators import splits, transforms

DAY = 24 * 60


def span(spark, days):
    return spark.createDataFrame([(at(0), at(days * DAY))], "start TIMESTAMP, end TIMESTAMP")


def role(folds, name):
    return [r[1:] for r in rows_of(folds.where(F.col("role") == name).select("fold", "start", "end"), "fold", "start")]


def test_rolling_plan_by_hand(spark):
    plan = splits.WalkForward(train="2d", test="1d", validation="1d", purge="1h", embargo="2h", warmup="6h")
    folds = splits.walk_forward(span(spark, 8), plan)
    h = 60
    assert role(folds, "train") == [(at(6 * h), at(54 * h)), (at(54 * h), at(102 * h))]
    assert role(folds, "test") == [(at(80 * h), at(104 * h)), (at(128 * h), at(152 * h))]
    assert role(folds, "warmup")[1] == (at(48 * h), at(54 * h))
    assert splits.overlapping_roles(folds).count() == 0


def test_expanding_keeps_its_start_and_purge_follows_the_label(spark):
    plan = splits.WalkForward(train="1d", test="1d", label_horizon="3h", purge="1h", expanding=True)
    assert plan.gap == 3 * 3600 * 10**6
    folds = splits.walk_forward(span(spark, 4), plan)
    assert [a for a, _ in role(folds, "train")] == [at(0), at(0)]
    assert role(folds, "purge")[0] == (at(DAY), at(DAY + 180))


def test_plan_refusals(spark):
    with pytest.raises(ValueError, match="gap"):
        splits.WalkForward(train="1d", test="1d")
    with pytest.raises(ValueError, match="no fold"):
        plan = splits.WalkForward(train="9d", test="1d", purge="1h")
        splits.require_folds(splits.walk_forward(span(spark, 5), plan))
    with pytest.raises(ValueError, match="shorter"):
        splits.fixed_split(spark, train=(T0, at(60)), test=(at(61), at(90)), purge="5m")


def test_fixed_split(spark):
    folds = splits.fixed_split(spark, train=(T0, at(60)), validation=(at(70), at(80)), test=(at(80), at(90)), warmup="10m")
    assert role(folds, "purge") == [(at(60), at(70))] and role(folds, "warmup") == [(at(-10), at(0))]


def test_excluded_ranges_skip_folds_and_renumber(spark):
    plan = splits.WalkForward(train="1d", test="1d", purge="1h", step="1d")
    banned = splits.ranges(spark, [("x", at(2 * DAY + 5), at(2 * DAY + 9))]).select("start", "end")
    folds = splits.walk_forward(span(spark, 9), plan, banned)
    assert [a for a, _ in role(folds, "train")] == [at(3 * DAY), at(4 * DAY), at(5 * DAY), at(6 * DAY)]


def test_sealed_windows(spark):
    windows = splits.sealed_windows(spark, [("w", at(2 * DAY), at(3 * DAY), "1h")])
    plan = splits.WalkForward(train="1d", test="1d", purge="1h", step="1d")
    folds = splits.walk_forward(span(spark, 6), plan)
    with pytest.raises(ValueError, match="sealed"):
        splits.check_sealed(folds, windows)
    splits.check_sealed(folds, windows, unsealed=["w"])
    rows = spark.createDataFrame([(at(2 * DAY - 60),), (at(2 * DAY - 61),), (at(3 * DAY + 60),)], "bar_start TIMESTAMP")
    assert splits.development_rows(rows, windows).count() == 2
    same = rows.where(splits.outside([(at(2 * DAY), at(3 * DAY), "1h")]))
    assert same.count() == 2


def test_roles_follow_availability_and_exclusions(spark):
    plan = splits.WalkForward(train="2d", test="1d", purge="1h", step="1d", embargo="3h")
    folds = splits.walk_forward(span(spark, 8), plan)
    rows = spark.range(0, 8 * 24).select(F.timestamp_micros(F.lit(int(T0.timestamp()) * 1_000_000) + F.col("id") * 3_600_000_000).alias("available_at"))
    tagged = splits.assign_roles(rows, folds)
    assert tagged.where("fold = 0 AND split_role = 'train'").count() == 48
    train = splits.training_rows(rows, folds).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in train] == [48, 48, 45, 42, 42], "earlier embargoes reach into later training"


def stats_rows(spark):
    rows = [(0, "train", float(v)) for v in (1, 2, 3, 4)] + [(1, "train", 7.0), (1, "train", 7.0)]
    return spark.createDataFrame(rows, "fold INT, split_role STRING, x DOUBLE")


def test_zscore_is_fitted_per_fold_and_constant_columns_are_null(spark):
    rows = stats_rows(spark)
    fitted = transforms.fit_zscore(rows, ["x"])
    got = transforms.apply_zscore(rows, fitted, ["x"]).orderBy("fold", "x").collect()
    assert got[0].x == pytest.approx(-1.5 / (5 / 3) ** 0.5) and got[4].x is None and got[5].x is None
    assert transforms.fit_zscore(rows, ["x"], ddof=0).orderBy("fold").first()["std"] == pytest.approx(1.25**0.5)
    with pytest.raises(Exception, match="cannot fit"):
        transforms.fit_zscore(rows.withColumn("split_role", F.lit("test")), ["x"]).collect()


def test_quantiles_interpolate_and_clip_keeps_null(spark):
    rows = stats_rows(spark)
    fitted = transforms.fit_winsor(rows, ["x"], lower=0.1, upper=0.5)
    first = fitted.orderBy("fold").first()
    assert (first.lower, first.upper) == pytest.approx((1.3, 2.5))
    apply_to = spark.createDataFrame([(0, "test", None), (0, "test", 9.0), (0, "test", -9.0)], rows.schema)
    got = [r.x for r in transforms.apply_winsor(apply_to, fitted, ["x"]).orderBy("x").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.3, 2.5])
