import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitbars.functions.scalars import bucket_of
from pitbars.operators.ordered import affine_fold, fold_rows, group_totals, hash_spread, rolling, running, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, several short ones, values with nulls, gaps in time."""
    rng = random.Random(3)
    rows, seen = [], set()
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice("abcd")
        t = rng.randrange(0, 5000)
        if (key, t) in seen:
            continue
        seen.add((key, t))
        rows.append((key, t, rng.choice([None, float(rng.randrange(-9, 9))])))
    return spark.createDataFrame(rows, "k STRING, t BIGINT, v DOUBLE").repartition(7).cache()


def test_running_equals_plain_window(skewed):
    split = running(
        skewed, ["k"], ["t"], bucket_of(F.col("t"), 97),
        sums={"s": F.col("v")}, lasts={"l": F.col("v")}, previous_lasts={"p": F.col("v")},
        maxs={"m": F.col("v")}, lags={"g": F.col("v")}, firsts={"f": F.col("v")},
    )
    w = Window.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0.0)), F.last("v", True).over(upto),
        F.last("v", True).over(before), F.max("v").over(upto), F.lag("v").over(w),
        F.first("v", True).over(upto),
    )
    assert sorted(map(str, split.collect())) == sorted(map(str, split.sparkSession.createDataFrame(
        plain.collect(), split.schema).collect()))


@pytest.mark.parametrize("chunk", [5, 8, 64])
def test_rolling_equals_plain_window_across_chunk_edges(skewed, chunk):
    def build(w):
        frame = w.rowsBetween(-4, 0)
        return {"n": F.count("v").over(frame), "m": F.max("v").over(frame), "g": F.lag("t", 4).over(w)}

    args = (skewed, ["k"], ["t"], bucket_of(F.col("t"), 211), 4, build)
    split = rolling(*args, chunk_rows=chunk)
    plain = rolling(*args, chunk_rows=None)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert split.count() == skewed.count()


def test_positions_are_exact(skewed):
    placed = with_position(skewed, ["k"], ["t"], bucket_of(F.col("t"), 50))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1
    assert placed.withColumn("r", rank).where("pos != r").count() == 0


def test_fold_matches_a_plain_loop_over_many_batches(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        steps = skewed.select("k", "t", F.coalesce("v", F.lit(0.0)).alias("b"),
                              F.when(F.col("t") % 11 == 0, 0.0).otherwise(0.5).alias("a"))
        fold = affine_fold(("a", "b"), (0.0,), lambda a, b: (a[:, None, None], b[:, None]))
        got = fold_rows(steps, ["k"], ["t"], bucket_of(F.col("t"), 130), fold).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    expected = {}
    for r in sorted(steps.collect(), key=lambda r: (r.k, r.t)):
        before = state.get(r.k, 0.0)
        state[r.k] = r.a * before + r.b
        expected[r.k, r.t] = (before, state[r.k])
    assert len(got) == len(expected)
    for r in got:
        assert (r.before, r.after) == pytest.approx(expected[r.k, r.t])


def test_a_state_vector_folds_like_a_plain_loop(spark, skewed):
    """Two numbers that feed each other: a decayed sum, and the total of its values before."""
    def step(v):
        a = np.tile(np.array([[0.5, 0.0], [1.0, 1.0]]), (len(v), 1, 1))
        return a, np.stack([v, np.zeros(len(v))], axis=1)

    rows = skewed.select("k", "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    fold = affine_fold(("v",), (1.0, 0.0), step)
    got = fold_rows(rows, ["k"], ["t"], bucket_of(F.col("t"), 130), fold, before=["x0", "y0"], after=["x", "y"])
    state = {}
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t)):
        x, y = state.get(r.k, (1.0, 0.0))
        state[r.k] = (0.5 * x + r.v, y + x)
        expected[r.k, r.t] = (x, y, *state[r.k])
    found = {(r.k, r.t): (r.x0, r.y0, r.x, r.y) for r in got.collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in expected)


def test_group_totals_reach_every_row(skewed):
    out = group_totals(skewed, ["k"], hash_spread("t", 5), sums={"n": F.lit(1)}, maxs={"hi": F.col("t")})
    whole = Window.partitionBy("k")
    bad = out.withColumns({"n2": F.count("*").over(whole), "hi2": F.max("t").over(whole)})
    assert bad.where("n != n2 OR hi != hi2").count() == 0
    assert out.count() == skewed.count()


def test_no_task_holds_a_whole_key(spark, skewed):
    plan = running(
        skewed, ["k"], ["t"], bucket_of(F.col("t"), 97), sums={"s": F.col("v")}
    )._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "__bucket" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
