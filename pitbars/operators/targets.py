"""Feature tables to target weights, decision batches, and episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.functions.rules import check_features, target_weight
from pitbars.functions.scalars import bucket_of, instant, time_bucket
from pitbars.operators.joins import interval_join
from pitbars.operators.ordered import Fold, fold_rows, running
from pitbars.session import staged
from pitbars.types import DAY, micros


def decision_instants(published: DataFrame, *, start=None, end=None) -> DataFrame:
    """Distinct publication instants inside ``[start, end)``."""
    rows = published.select(F.col("available_at").alias("decision_at"))
    if start is not None:
        rows = rows.where(F.col("decision_at") >= instant(start))
    if end is not None:
        rows = rows.where(F.col("decision_at") < instant(end))
    return rows.distinct()


def validity(
    published: DataFrame, *, entity: str = "instrument_id", width: int = DAY
) -> DataFrame:
    """Each published row with the span in which it is its instrument's latest.

    ``valid_from`` is its own publication and ``valid_to`` the next one (null for the last
    row): the compact form of every decision batch at once.
    """
    latest_first = published.withColumn("__back", -F.unix_micros("available_at"))
    order = ["__back", "__later"]
    ranked = latest_first.withColumn("__later", -F.unix_micros("bar_start"))
    out = running(
        ranked, [entity], order, bucket_of(F.col("__back"), width),
        lags={"valid_to": F.col("available_at")},
    )
    kept = out.withColumn("valid_from", F.col("available_at")).drop(*order)
    return kept.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def decision_batches(
    published: DataFrame, instants: DataFrame, *, entity: str = "instrument_id", width: int = DAY
) -> DataFrame:
    """For each instant and instrument, the latest row published by then.

    Only instruments that have published appear. Instants meet rows through the spans in
    which rows are the latest, bucketed by time.
    """
    last = instants.agg(F.timestamp_micros(F.max(F.unix_micros("decision_at")) + 1)).scalar()
    spans = validity(published, entity=entity, width=width)
    closed = spans.withColumn("valid_to", F.coalesce("valid_to", last)).withColumnRenamed(
        "available_at", "__available_at"
    )
    found = interval_join(
        instants, closed, at="decision_at", start="valid_from", end="valid_to", width=width
    ).withColumnRenamed("__available_at", "available_at")
    rest = [c for c in published.columns if c != entity]
    return found.select("decision_at", entity, *rest)


def recent_rows(published: DataFrame, as_of, n: int, *, entity: str = "instrument_id") -> DataFrame:
    """The ``n`` most recent rows per instrument that were available at ``as_of``."""
    visible = published.where(F.col("available_at") <= instant(as_of))
    w = Window.partitionBy(entity).orderBy(F.desc("bar_start"), F.desc("available_at"))
    return visible.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def lagged_signal(
    features: DataFrame, feature: str, *, threshold: float = 0.0, weight: float = 0.5,
    instruments: Sequence[str] | None = None,
) -> DataFrame:
    """Long ``weight`` where a feature exceeds the threshold, else flat; missing gives no target."""
    rows = features.where(F.col(feature).isNotNull())
    if instruments is not None:
        rows = rows.where(F.col("instrument_id").isin(list(instruments)))
    above = (F.col(feature) > threshold) & ~F.isnan(F.col(feature).cast("double"))
    return rows.select(
        "instrument_id",
        F.col("available_at").alias("decision_at"),
        "bar_start",
        F.when(above, weight).otherwise(0.0).alias("target"),
    )


def rule_targets(
    features: DataFrame, rule: Mapping, *, max_positions: int | None = None,
    rank_by: str | None = None, rank_ascending: bool = False, at: str = "available_at",
) -> DataFrame:
    """Target weight per row; with ``max_positions`` only the best names keep theirs."""
    check_features(features, rule, rank_by)
    rows = features.withColumn("target", target_weight(rule))
    if max_positions is None:
        return rows
    wanted = rows.where(F.col("target") != 0)
    kept = top_k(wanted, max_positions, at=at, rank_by=rank_by, ascending=rank_ascending)
    keys = ["instrument_id", "bar_start", at]
    chosen = kept.select(*keys, F.lit(True).alias("__keep"))
    joined = rows.join(chosen, keys, "left")
    return joined.withColumn(
        "target", F.when(F.col("__keep"), F.col("target")).otherwise(0.0)
    ).drop("__keep")


def top_k(
    rows: DataFrame, k: int, *, at: str, rank_by: str | None = None, ascending: bool = False,
    entity: str = "instrument_id",
) -> DataFrame:
    """The ``k`` best rows per instant: by score, then by descending id; missing scores last.

    Spark keeps ``k`` rows per instant on the map side, so a crowded instant stays cheap.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order: list[Column] = []
    if rank_by is not None:
        score = _number(rank_by)
        order.append(score.asc_nulls_last() if ascending else score.desc_nulls_last())
    order.append(F.col(entity).desc())
    w = Window.partitionBy(at).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def rule_changes(
    targets: DataFrame, instants: DataFrame, *, entity: str = "instrument_id", at: str = "decision_at",
    width: int = DAY,
) -> DataFrame:
    """Targets as changes: what a book has to do at each instant to follow its targets.

    ``targets`` holds ``entity, at, target``, one row per name and instant at most; the names
    whose target is not zero (nor missing) are the instant's qualifying set. A name that
    enters the set, or whose target moves within it, yields its target. A name that was in the
    set at the instant before and is not in it now yields a closing zero, whether it has a row
    at this instant or none. ``instants`` is the clock; instants without any row close
    everything. Adds ``previous_target``.

    Instants are numbered once; a name that stays is one whose last number is one less. The
    next number is found likewise, so the set is never compared with itself.
    """
    clock = instants.select(at).distinct().withColumn("__all", F.lit(0))
    numbered = running(clock, ["__all"], [at], time_bucket(at, width), sums={"__no": F.lit(1).cast("bigint")})
    numbered = staged(numbered.select(at, "__no"), "clock")
    inside = targets.where((F.col("target") != 0) & ~F.isnan("target")).select(entity, at, "target")
    inside = inside.join(numbered, at)
    order, bucket = [at], time_bucket(at, width)
    state = F.struct("__no", "target")
    seen = running(inside, [entity], order, bucket, lags={"__last": state})
    back = seen.withColumn("__back", -F.unix_micros(at))
    seen = staged(
        running(back, [entity], ["__back"], bucket_of(F.col("__back"), width), lags={"__next": F.col("__no")}), "qualifying"
    )
    stayed = F.coalesce(F.col("__last.__no") == F.col("__no") - 1, F.lit(False))
    before = F.when(stayed, F.col("__last.target")).otherwise(0.0)
    moved = seen.select(entity, at, "target", before.alias("previous_target")).where("target != previous_target")
    left = seen.where(F.col("__next").isNull() | (F.col("__next") > F.col("__no") + 1))
    closing = left.select(entity, (F.col("__no") + 1).alias("__no"), F.col("target").alias("previous_target"))
    closing = closing.join(numbered, "__no").select(entity, at, F.lit(0.0).alias("target"), "previous_target")
    return moved.unionByName(closing)


def target_changes(
    targets: DataFrame, *, keys: Sequence[str] = ("instrument_id",), at: str = "decision_at",
    tiebreak: Sequence[str] = ("bar_start",), width: int = DAY,
) -> DataFrame:
    """Rows where the target differs from the one before; a first zero is no change."""
    seen = running(
        targets, list(keys), [at, *tiebreak], time_bucket(at, width),
        lags={"previous_target": F.col("target")},
    )
    before = F.coalesce("previous_target", F.lit(0.0))
    return seen.where(F.col("target") != before)


def hysteresis_long(
    rows: DataFrame, *, zscore: str, entry_z: float, exit_z: float = 0.0,
    gate: Column | None = None, keys: Sequence[str] = ("instrument_id",),
    at: str = "bar_start", width: int = DAY,
) -> DataFrame:
    """Adds ``state``: 1 from a stretch below ``-entry_z`` until back above ``-exit_z``.

    Entry and exit cannot both hold on one row, so the last of the two decides and a
    running last value is exact. ``gate`` restricts entries only; a missing score holds.
    """
    _check_levels(entry_z, exit_z)
    z = _number(zscore)
    enter = (z <= -entry_z) if gate is None else ((z <= -entry_z) & F.coalesce(gate, F.lit(False)))
    event = F.when(enter, 1).when(z >= -exit_z, 0)
    out = running(rows, list(keys), [at], time_bucket(at, width), lasts={"state": event})
    return out.withColumn("state", F.coalesce("state", F.lit(0)))


def _number(name: str) -> Column:
    """A score with NaN as missing; Spark sorts NaN above every number."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _check_levels(entry_z: float, exit_z: float) -> None:
    if entry_z <= 0 or exit_z >= entry_z:
        raise ValueError("need 0 < entry_z and exit_z < entry_z")


def hysteresis(
    rows: DataFrame, *, zscore: str, entry_z: float, exit_z: float = 0.0, sides: str = "both",
    rank_feature: str | None = None, min_rank: float = 0.0,
    trend_feature: str | None = None, min_trend: float = 0.0,
    keys: Sequence[str] = ("instrument_id",), at: str = "bar_start", width: int = 30 * DAY,
) -> DataFrame:
    """Adds ``state`` in {-1, 0, 1}: two-sided stretch episodes, assuming entries fill.

    A row leaves a position without taking the other side on the same row, so long and
    short cannot be scanned separately. Columns give each row's next state from short, flat
    and long, and a stretch of rows is again such a triple.
    """
    _check_levels(entry_z, exit_z)
    if sides not in ("long", "short", "both"):
        raise ValueError(f"unknown sides {sides!r}")
    z = _number(zscore)
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok = F.lit(True) if rank_feature is None else yes(_number(rank_feature) >= min_rank)
    up = down = ok
    if trend_feature is not None:
        trend = _number(trend_feature)
        up = up & yes(trend > min_trend)
        down = down & yes(-trend > min_trend)
    go_long = yes(z <= -entry_z) & up & F.lit(sides != "short")
    go_short = yes(z >= entry_z) & down & F.lit(sides != "long")
    moves = rows.withColumns(
        {
            "from_short": F.when(yes(z <= exit_z), 0).otherwise(-1),
            "from_flat": F.when(go_long, 1).when(go_short, -1).otherwise(0),
            "from_long": F.when(yes(z >= -exit_z), 0).otherwise(1),
        }
    )
    inputs = ("from_short", "from_flat", "from_long")
    fold = Fold(
        inputs=inputs,
        start=(0.0,),
        identity=(-1.0, 0.0, 1.0),
        step=lambda *to: np.stack(to, axis=1).astype(float),
        compose=lambda x, y: np.take_along_axis(y, x.astype(int) + 1, axis=1),
        apply=lambda state, s: np.take_along_axis(s, state.astype(int) + 1, axis=1),
    )
    done = fold_rows(moves, list(keys), [at], time_bucket(at, width), fold)
    return done.select(*rows.columns, F.col("after").cast("int").alias("state"))


def scheduled(
    instants: DataFrame, every, *, keys: Sequence[str] = (), at: str = "decision_at",
    width: str | int = DAY,
) -> DataFrame:
    """The first instant, then each first instant at least ``every`` after the last chosen.

    The choice is sequential, but where it goes from an instant does not depend on how it got
    there. One ordered scan finds every instant's successor; the successors are then followed
    by doubling: in round ``k`` the instants chosen so far jump ``2 ** k`` choices ahead at
    once, and the jumps are joined with themselves. Only the first instant and instants that
    are somebody's successor can be chosen, so no others are jumped from. Rounds are stored;
    there are about log2 of the number of choices. A clock that belongs to one key is spread
    over its own instants. Missing instants are left out.
    """
    gap = micros(every)
    named = list(keys) or ["__all"]
    base = instants if keys else instants.withColumn("__all", F.lit(0))
    moments = staged(
        base.where(F.col(at).isNotNull()).select(*named, F.unix_micros(at).alias("us")).distinct(), "instants"
    )
    hops = _successors(moments, named, gap, width)
    chosen = moments.groupBy(*named).agg(F.min("us").alias("us"))
    targets = hops.select(*named, F.col("next").alias("us")).unionByName(chosen).distinct()
    jumps = staged(hops.join(targets, [*named, "us"]), "jumps")
    while not jumps.isEmpty():
        ahead = chosen.join(jumps, [*named, "us"]).select(*named, F.col("next").alias("us"))
        chosen = staged(chosen.unionByName(ahead), "chosen")
        further = jumps.select(*named, F.col("next").alias("further"), F.col("us").alias("next"))
        jumps = staged(
            jumps.join(further, [*named, "next"]).select(*named, "us", F.col("further").alias("next")), "jumps"
        )
    return chosen.select(*keys, F.timestamp_micros("us").alias(at))


def _successors(moments: DataFrame, keys: Sequence[str], gap: int, width: str | int) -> DataFrame:
    """``us, next``: the first moment at least ``gap`` after each one that has such a moment."""
    probes = moments.select(*keys, (-F.col("us") - gap).alias("back"), F.lit(1).alias("kind"), F.col("us").alias("from"))
    there = moments.select(*keys, (-F.col("us")).alias("back"), F.lit(0).alias("kind"), F.col("us").alias("to"))
    # Latest first, so the last moment seen is the earliest at or after the probe.
    seen = running(
        there.unionByName(probes, allowMissingColumns=True), list(keys), ["back", "kind"],
        bucket_of(F.col("back"), micros(width)), lasts={"next": F.col("to")},
    )
    return seen.where("kind = 1 and next is not null").select(*keys, F.col("from").alias("us"), "next")


def weights_at(instants: DataFrame, published: DataFrame, weights: Mapping[str, float], *,
               at: str = "decision_at") -> DataFrame:
    """Target weights at each instant for the listed names that have published by then."""
    named = instants.withColumn("instrument_id", F.explode(F.array(*map(F.lit, weights))))
    due = named.join(_first_published(published, weights), "instrument_id")
    return due.where(F.col(at) >= F.col("first_at")).select(
        *instants.columns, "instrument_id", "target"
    )


def _first_published(published: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row per listed name: when it first published. Sized by the list, not by the data."""
    listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return (
        published.where(F.col("instrument_id").isin(list(weights)))
        .groupBy("instrument_id")
        .agg(F.min("available_at").alias("first_at"))
        .withColumn("target", listed[F.col("instrument_id")].cast("double"))
    )


def initial_allocation(
    instants: DataFrame, published: DataFrame, weights: Mapping[str, float]
) -> DataFrame:
    """Targets at each decision until the first at which every listed name has a price."""
    firsts = _first_published(published, weights)
    complete = firsts.agg(
        F.when(F.count(F.lit(1)) == len(weights), F.max("first_at"))
    ).scalar()
    done = instants.where(F.col("decision_at") >= complete).agg(F.min("decision_at")).scalar()
    until = instants.where(F.col("decision_at") <= F.coalesce(done, F.col("decision_at")))
    return weights_at(until.select("decision_at"), published, weights)
