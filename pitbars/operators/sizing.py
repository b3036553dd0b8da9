"""Target sizing: intents of one decision become order quantities together.

Limits that bind across instruments scale every increasing order of a decision by one
common factor, so the result does not depend on row order. The totals behind a factor are
partial sums per ``(decision, instrument hash)``; a decision with very many names is not
gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import floor_to_increment
from pitbars.operators.ordered import group_totals, hash_spread
from pitbars.session import staged
from pitbars.types import require_columns

EPS = 1e-9


@dataclass(frozen=True)
class Limits:
    allow_short: bool = False
    max_gross: float = 1.0
    max_weight: float = 1.0
    cost_buffer_bps: float = 10.0


def _toward(quantity: Column) -> Column:
    return floor_to_increment(quantity, F.col("increment"), EPS)


def size_targets(
    intents: DataFrame, decisions: DataFrame, holdings: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Signed order quantity and, where there is none, the reason.

    Args:
        intents: ``decision_at, created_at, instrument_id, kind, value`` with kind one of
            ``delta``, ``target_quantity``, ``target_weight``.
        decisions: ``decision_at, equity, cash``.
        holdings: ``decision_at, instrument_id, mark, position, pending, increment`` for
            every known instrument; mark may be null.
    """
    key = ["decision_at", "instrument_id"]
    require_columns(intents, [*key, "created_at", "kind", "value"], "intents")
    work = intents.join(decisions, "decision_at").join(holdings, key, "left")
    held = F.coalesce("position", F.lit(0.0)) + F.coalesce("pending", F.lit(0.0))
    work = work.withColumn("base", held)
    work = _requested(work)
    work = _round_and_short(work, limits)
    # Each limit below reads the batch twice (totals, then rows).
    work = staged(_position_limit(work, limits), "sizing")
    work = staged(_gross_limit(work, holdings, limits), "sizing")
    work = _cash_limit(work, limits)
    return work.select(
        *intents.columns,
        "requested",
        F.col("quantity").alias("final_quantity"),
        "rejection",
    )


def _requested(work: DataFrame) -> DataFrame:
    kind, value = F.col("kind"), F.col("value")
    by_weight = value * F.col("equity") / F.col("mark") - F.col("base")
    asked = (
        F.when(kind == "delta", value)
        .when(kind == "target_quantity", value - F.col("base"))
        .when(kind == "target_weight", by_weight)
    )
    unpriced = (kind == "target_weight") & F.coalesce(F.col("mark") <= 0, F.lit(True))
    reason = (
        F.when(F.col("created_at") != F.col("decision_at"), "stale_intent")
        .when(F.col("increment").isNull(), "unknown_instrument")
        .when(unpriced, "no_mark")
    )
    work = work.withColumn("rejection", reason)
    asked = F.when(F.col("rejection").isNull(), asked).otherwise(0.0)
    return work.withColumn("requested", asked).withColumn("quantity", F.col("requested"))


def _round_and_short(work: DataFrame, limits: Limits) -> DataFrame:
    live = F.col("rejection").isNull()
    resized = F.col("quantity")
    if not limits.allow_short:
        resized = F.when(F.col("base") + resized < 0, -F.col("base")).otherwise(resized)
    work = work.withColumn("__asked", resized)
    work = work.withColumn("__rounded", F.when(live, _toward(F.col("__asked"))).otherwise(0.0))
    nothing = live & (F.col("__rounded") == 0) & (F.col("requested") != 0)
    short = (F.col("__asked") == 0) & (F.col("requested") < 0) & F.lit(not limits.allow_short)
    reason = F.when(nothing & short, "short_not_allowed").when(nothing, "below_increment")
    return work.withColumns(
        {"rejection": F.coalesce("rejection", reason), "quantity": F.col("__rounded") + F.lit(0.0)}
    ).drop("__asked", "__rounded")


def _resize(work: DataFrame, applies: Column, target: Column, reason: str) -> DataFrame:
    """Move ``base`` to ``target`` where ``applies``; a step that vanishes or turns is refused."""
    work = work.withColumn("__new", F.when(applies, _toward(target - F.col("base"))))
    refused = F.col("__new").isNotNull() & (
        (F.col("__new") == 0) | ((F.col("__new") > 0) != (F.col("quantity") > 0))
    )
    return (
        work.withColumn("__refused", refused)
        .withColumns(
            {
                "rejection": F.coalesce("rejection", F.when(F.col("__refused"), F.lit(reason))),
                "quantity": F.when(F.col("__refused"), 0.0)
                .when(F.col("__new").isNotNull(), F.col("__new"))
                .otherwise(F.col("quantity")),
            }
        )
        .drop("__new", "__refused")
    )


def _active() -> Column:
    return F.col("rejection").isNull() & (F.col("quantity") != 0)


def _position_limit(work: DataFrame, limits: Limits) -> DataFrame:
    cap = F.lit(limits.max_weight) * F.col("equity")
    projected = F.col("base") + F.col("quantity")
    grows = F.abs(projected) > F.abs("base")
    over = F.abs(projected) * F.col("mark") > cap + EPS
    target = F.signum(projected) * F.try_divide(cap, F.col("mark"))
    return _resize(work, _active() & grows & over, target, "position_limit")


def _gross_limit(work: DataFrame, holdings: DataFrame, limits: Limits) -> DataFrame:
    active = work.where(_active()).select("decision_at", "instrument_id").distinct()
    idle = holdings.join(active, ["decision_at", "instrument_id"], "left_anti")
    counted = F.when(F.col("position") != 0, F.col("position")).otherwise(
        F.coalesce("pending", F.lit(0.0))
    )
    idle = idle.select(
        "decision_at", "instrument_id", F.abs(counted * F.col("mark")).alias("__fixed")
    ).where(F.col("__fixed") != 0)

    projected = F.abs(F.col("base") + F.col("quantity"))
    base = F.abs("base")
    on = _active() & F.col("mark").isNotNull()
    rows = work.withColumns(
        {
            "__intent": F.lit(1),
            "__grows": F.coalesce(on & (projected > base), F.lit(False)),
            "__fixed": F.when(on, F.least(projected, base) * F.col("mark")).otherwise(0.0),
            "__delta": F.when(on & (projected > base), (projected - base) * F.col("mark")).otherwise(0.0),
        }
    )
    both = rows.unionByName(idle, allowMissingColumns=True)
    summed = group_totals(
        both,
        ["decision_at"],
        hash_spread("instrument_id"),
        sums={"__sum_fixed": F.col("__fixed"), "__sum_delta": F.col("__delta")},
    ).where(F.col("__intent") == 1)
    limit = F.lit(limits.max_gross) * F.col("equity")
    over = F.col("__sum_fixed") + F.col("__sum_delta") > limit + EPS
    factor = F.greatest(
        F.lit(0.0), F.try_divide(limit - F.col("__sum_fixed"), F.col("__sum_delta"))
    )
    whole = F.col("base") + F.col("quantity")
    scaled = base + factor * (F.abs(whole) - base)
    sized = _resize(summed, F.col("__grows") & over, F.signum(whole) * scaled, "gross_exposure")
    return sized.drop("__intent", "__grows", "__fixed", "__delta", "__sum_fixed", "__sum_delta")


def _cash_limit(work: DataFrame, limits: Limits) -> DataFrame:
    value = F.col("quantity") * F.col("mark")
    live = F.col("rejection").isNull()
    cost = F.when(live & (F.col("quantity") > 0), value * (1 + limits.cost_buffer_bps / 1e4))
    proceeds = F.when(live & (F.col("quantity") < 0), -value)
    summed = group_totals(
        work,
        ["decision_at"],
        hash_spread("instrument_id"),
        sums={
            "__cost": F.coalesce(cost, F.lit(0.0)),
            "__proceeds": F.coalesce(proceeds, F.lit(0.0)),
        },
    )
    funds = F.col("cash") + F.col("__proceeds")
    short = (F.col("__cost") > funds + EPS) & live & (F.col("quantity") > 0)
    factor = F.greatest(F.lit(0.0), F.try_divide(funds, F.col("__cost")))
    summed = summed.withColumn("__new", F.when(short, _toward(F.col("quantity") * factor)))
    dry = F.col("__new") <= 0
    return summed.withColumns(
        {
            "rejection": F.coalesce("rejection", F.when(dry, "insufficient_cash")),
            "quantity": F.coalesce(F.when(dry, 0.0).otherwise(F.col("__new")), F.col("quantity")),
        }
    ).drop("__new", "__cost", "__proceeds")
