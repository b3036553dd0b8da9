"""Positions, average cost, equity curves, reconciliation, and flat-to-flat trades.

Ledgers are keyed by whatever identifies a run (``run``, ``fold``, ``role``) plus the
instrument. Running quantities use time-bucketed prefix sums, so one instrument with most
of the fills is spread over its own history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.functions.scalars import bucket_of, elapsed, time_bucket
from pitbars.operators.joins import nearest
from pitbars.operators.ordered import affine_fold, by_key_size, fold_rows, running, with_position
from pitbars.session import staged
from pitbars.types import DAY, SECOND, micros

#: How much of its history a key has in one task: coarse, since a ledger has many short keys
#: and every bucket costs a carried row. A ledger with denser keys states a finer width.
LEDGER_BUCKET = 30 * DAY
FLAT = 1e-9
SPREADS = 64
RECONCILE_RTOL = 1e-9


def signed_quantity() -> Column:
    return F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))


def snapped(value: Column) -> Column:
    """Rounding residue of a running sum near zero counts as flat."""
    return F.when(F.abs(value) <= FLAT, F.lit(0.0)).otherwise(value)


def positions(
    fills: DataFrame, *, keys: Sequence[str] = ("instrument_id",), order: Sequence[str],
    width: int = LEDGER_BUCKET,
) -> DataFrame:
    """Fills with the position before and after each; large keys are split into ``width`` of time."""
    return by_key_size(fills, keys, lambda rows, split: _positions(rows, keys, order, _bucket(order[0], width, split)))


def _bucket(at: str, width: int, split: bool) -> Column | None:
    return time_bucket(at, width) if split else None


def _positions(fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame:
    out = running(
        fills.withColumn("signed", signed_quantity()), list(keys), list(order), bucket,
        sums={"position": F.col("signed")},
    )
    return out.withColumns(
        {
            "position_before": snapped(F.col("position") - F.col("signed")),
            "position": snapped(F.col("position")),
        }
    )


def average_cost(
    fills: DataFrame, *, keys: Sequence[str] = ("instrument_id",), order: Sequence[str],
    width: int = LEDGER_BUCKET,
) -> DataFrame:
    """Fills with ``position``, ``avg_cost`` after, ``realized_pnl`` of each fill, and the
    totals ``basis_before, basis, realized_before, realized`` of the key around it.

    Adding blends the cost, reducing keeps it and realises against it, flipping restarts it
    at the fill price. The position is a prefix sum. Given it, a fill maps the pair of cost
    basis and realised profit linearly, ``basis' = a * basis + b`` and
    ``realized' = realized + c * basis + d``; a stretch of fills is again one such map, which is
    what makes the fold splittable.
    """
    return by_key_size(fills, keys, lambda rows, split: _average_cost(rows, keys, order, _bucket(order[0], width, split)))


def _average_cost(fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame:
    held = _positions(fills, keys, order, bucket)
    before, after = F.col("position_before"), F.col("position")
    adds = (before == 0) | ((before > 0) == (F.col("signed") > 0))
    flips = ~adds & (after != 0) & ((after > 0) != (before > 0))
    closed = F.when(adds, 0.0).otherwise(
        -F.signum(before) * F.least(F.abs("signed"), F.abs(before))
    )
    steps = held.withColumns(
        {
            "__a": F.when(adds, 1.0).when(flips, 0.0).otherwise(F.try_divide(after, before)),
            "__b": F.when(adds, F.col("signed") * F.col("price"))
            .when(flips, after * F.col("price"))
            .otherwise(0.0),
            "__c": F.coalesce(F.try_divide(closed, before), F.lit(0.0)),
            "__d": -closed * F.col("price"),
        }
    )

    def step(a, b, c, d):
        matrix = np.zeros((len(a), 2, 2))
        matrix[:, 0, 0], matrix[:, 1, 0], matrix[:, 1, 1] = a, c, 1.0
        return matrix, np.stack([b, d], axis=1)

    fold = affine_fold(("__a", "__b", "__c", "__d"), (0.0, 0.0), step)
    joined = fold_rows(
        steps, list(keys), list(order), bucket, fold,
        before=["basis_before", "realized_before"], after=["basis", "realized"],
    )
    cost_before = F.coalesce(F.try_divide(F.col("basis_before"), before), F.lit(0.0))
    return joined.withColumns(
        {
            "avg_cost": F.when(after == 0, 0.0).otherwise(F.try_divide(F.col("basis"), after)),
            "realized_pnl": -closed * (F.col("price") - cost_before),
        }
    ).drop("__a", "__b", "__c", "__d")


def equity_curve(
    fills: DataFrame,
    marks: DataFrame,
    *,
    initial_cash: float,
    run: Sequence[str] = (),
    fill_order: Sequence[str] = ("fill_at",),
    width: int = DAY,
    accounts: DataFrame | None = None,
    pnl: bool = False,
) -> DataFrame:
    """Cash, equity and exposure at every instant where a fill or a mark occurs.

    With ``pnl`` also ``realized_pnl`` (before fees, to date) and ``unrealized_pnl`` (market
    value of what is open less its average cost). A fill's change of basis and of realised
    profit comes from the fold of :func:`average_cost` and is summed up along with the cash.

    ``accounts`` lists the runs (the run columns); each has a curve, also one that never
    traded. Without it the runs are those that have fills.

    ``marks`` carry ``instrument_id, at, price`` (and the run columns); at equal instants a
    fill comes before a mark. Each event contributes the change it makes to its own
    instrument's value; the changes are summed per instant and accumulated over time, so
    no instants-by-instruments panel is built. An instrument that trades before its first
    mark is valued at its first fill's reference price until then.
    """
    key = [*run, "instrument_id"]
    extra = [c for c in fill_order if c != "fill_at"]
    if pnl:
        fills = average_cost(fills, keys=key, order=fill_order)
        gain = F.col("realized") - F.col("realized_before")
        gains = {"d_basis": F.col("basis") - F.col("basis_before"), "d_realized": gain}
    else:
        gains = {}
    trades = fills.select(
        *key, F.col("fill_at").alias("at"), F.lit(0).alias("__kind"), *extra,
        signed_quantity().alias("signed"),
        "price", "fee", "reference_price", *[c.alias(n) for n, c in gains.items()],
    )
    # Only instruments that trade can change the account. Marks without run columns serve
    # every run that trades the instrument.
    traded = fills.select(*key).distinct()
    shared = [c for c in key if c in marks.columns]
    prices = marks.join(traded, shared).select(
        *key, "at", F.lit(1).alias("__kind"), F.col("price").alias("mark")
    )
    events = trades.unionByName(prices, allowMissingColumns=True)
    order = ["at", "__kind", *extra]
    bucket = time_bucket("at", width)
    scanned = running(
        events, key, order, bucket,
        sums={"__pos": F.coalesce("signed", F.lit(0.0))},
        lasts={"__mark": F.col("mark")},
        previous_lasts={"__mark0": F.col("mark")},
        firsts={"__ref1": F.col("reference_price")},
    )
    now = F.coalesce("__mark", "__ref1")
    prior = F.coalesce("__mark0", "__ref1")
    pos = snapped(F.col("__pos"))
    pos0 = snapped(F.col("__pos") - F.coalesce("signed", F.lit(0.0)))
    value, value0 = pos * now, F.when(pos0 == 0, 0.0).otherwise(pos0 * prior)
    cash = -F.col("signed") * F.col("price") - F.col("fee")
    deltas = scanned.select(
        *run, "at",
        F.coalesce(cash, F.lit(0.0)).alias("cash"),
        F.coalesce("fee", F.lit(0.0)).alias("fee"),
        (value - value0).alias("net"),
        (F.abs(value) - F.abs(value0)).alias("gross"),
        ((pos != 0).cast("int") - (pos0 != 0).cast("int")).alias("count"),
        *[F.coalesce(n, F.lit(0.0)).alias(n.removeprefix("d_")) for n in gains],
    )
    # Every publication is a snapshot, also of instruments that never trade.
    held = [c for c in run if c in marks.columns]
    clock = marks.select(*held, "at").distinct()
    if run:
        listed = (fills if accounts is None else accounts).select(*run).distinct()
        # Each account gets every instant of its marks: the list is repeated once per spread,
        # so that instants meet it in many tasks.
        spread = listed.withColumn("__spread", F.explode(F.sequence(F.lit(0), F.lit(SPREADS - 1))))
        clock = (
            clock.withColumn("__spread", F.pmod(F.xxhash64("at"), F.lit(SPREADS)).cast("int"))
            .join(spread, [*held, "__spread"]).select(*run, "at")
        )
    deltas = deltas.unionByName(clock, allowMissingColumns=True).fillna(0)
    summed = ["cash", "fee", "net", "gross", "count", *[n.removeprefix("d_") for n in gains]]
    per_instant = deltas.groupBy(*run, "at").agg(*[F.sum(c).alias(f"__d_{c}") for c in summed])
    frame = per_instant if run else per_instant.withColumn("__run", F.lit(0))
    total = running(
        frame, list(run) or ["__run"], ["at"], bucket, sums={c: F.col(f"__d_{c}") for c in summed},
    )
    # Changes that cancel leave a rounding residue, which is no exposure once nothing is held.
    total = total.withColumns({c: F.when(F.col("count") == 0, 0.0).otherwise(F.col(c)) for c in ("net", "gross")})
    earned = [F.col("realized").alias("realized_pnl"), (F.col("net") - F.col("basis")).alias("unrealized_pnl")]
    cash_now = F.lit(float(initial_cash)) + F.col("cash")
    return total.select(
        *run, "at",
        cash_now.alias("cash"),
        (cash_now + F.col("net")).alias("equity"),
        F.col("gross").alias("gross_exposure"),
        F.col("net").alias("net_exposure"),
        F.col("fee").alias("fees_paid"),
        F.col("count").cast("int").alias("position_count"),
        *(earned if pnl else []),
    )


def reconcile(curve: DataFrame, *, initial_cash: float, rtol: float = RECONCILE_RTOL) -> DataFrame:
    """Instants where equity is not cash flow plus P&L; empty for a sound ledger.

    Checks ``equity = initial + realised + unrealised - fees`` on a curve made with ``pnl``.
    """
    start = F.lit(float(initial_cash))
    right = start + F.col("realized_pnl") + F.col("unrealized_pnl") - F.col("fees_paid")
    scale = F.greatest(F.abs("equity"), F.abs(right), start, F.lit(1.0))
    return curve.withColumn("identity", right).where(
        F.abs(F.col("equity") - F.col("identity")) > rtol * scale
    )


def stale_marks(
    held: DataFrame, marks: DataFrame, *, at: str, limit, run: Sequence[str] = ()
) -> DataFrame:
    """Open positions valued at a mark older than ``limit``."""
    found = nearest(
        held, marks, left_on=F.col(at), right_on=F.col("at"),
        by=[*run, "instrument_id"], tiebreak=["price"], name="__mark", short_keys=True,
    )
    age = elapsed(F.col(at), F.col("__mark.at"))
    out = found.withColumns({"mark_at": F.col("__mark.at"), "age_us": age}).drop("__mark")
    return out.where((F.col("position") != 0) & (F.col("age_us") > micros(limit)))


def stale_spans(
    held: DataFrame, marks: DataFrame, clock: DataFrame, *, at: str = "fill_at", limit,
    run: Sequence[str] = (), order: Sequence[str] = (), width: int = LEDGER_BUCKET,
) -> DataFrame:
    """Spans in which an open position is valued at a mark older than ``limit``.

    ``held`` are fills with their ``position`` (:func:`positions`), in ``order``; ``marks`` hold
    ``instrument_id, at``; ``clock`` the instants ``at`` at which the book is valued. A span
    begins when the last mark passes the limit while the position is open, or when a position
    is opened behind such a mark, and ends with a fresh mark or a flat position. One row per
    key and span the clock sees: ``mark_at, stale_from, stale_to`` (null while it lasts),
    ``first_at`` and ``occurrences``, the clock's first instant within and their number.

    Fills, marks and the instants at which marks expire are one ordered scan; spans meet the
    clock by counting its instants, not by pairing with them.
    """
    key, gap = [*run, "instrument_id"], micros(limit)
    last = F.struct(*[F.col(c) for c in (order or [at])], "position")
    fills = held.select(*key, F.col(at).alias("at"), last.alias("__last"))
    priced = marks.select(*[c for c in key if c in marks.columns], "at").distinct()
    shared = [c for c in key if c in priced.columns]
    priced = priced.join(held.select(*key).distinct(), shared).select(*key, "at", F.col("at").alias("mark_at"))
    expired = priced.select(*key, F.timestamp_micros(F.unix_micros("at") + gap).alias("at"))
    events = fills.unionByName(priced, allowMissingColumns=True).unionByName(expired, allowMissingColumns=True)
    events = events.groupBy(*key, "at").agg(F.max("__last")["position"].alias("position"), F.max("mark_at").alias("mark_at"))
    spans = by_key_size(
        staged(events, "events"), key, lambda rows, split: _spans(rows, key, gap, _bucket("at", width, split))
    )
    spans = staged(spans, "spans")
    first = F.unix_micros("stale_from") + 1 - F.col("__now")
    counted = _counted_before(clock, spans.select(first.alias("us")).unionByName(spans.select(F.unix_micros("stale_to").alias("us"))), width)
    ahead, total = counted.select(F.col("us").alias("__us"), "__n", "__next"), clock.select("at").distinct().count()
    out = spans.withColumn("__us", first).join(ahead, "__us").withColumnsRenamed({"__n": "__n0", "__next": "first_us"})
    out = out.drop("__us").withColumn("__us", F.unix_micros("stale_to")).join(ahead.drop("__next"), "__us", "left")
    number = F.coalesce("__n", F.lit(total)) - F.col("__n0")
    return out.withColumn("occurrences", number.cast("bigint")).where("occurrences > 0").select(
        *key, "mark_at", "stale_from", "stale_to", F.timestamp_micros("first_us").alias("first_at"), "occurrences"
    )


def _spans(events: DataFrame, key: Sequence[str], gap: int, bucket: Column | None) -> DataFrame:
    """Where staleness begins and ends, from the events ``at, position, mark_at`` of each key."""
    seen = running(events, key, ["at"], bucket, lasts={"held": F.col("position"), "mark": F.col("mark_at")})
    open_ = F.coalesce(F.col("held"), F.lit(0.0)) != 0
    age = elapsed("at", "mark")
    # Stale just after this instant; `now` if at it already.
    state = seen.select(
        *key, "at", F.col("mark").alias("mark_at"), F.coalesce(open_ & (age >= gap), F.lit(False)).alias("stale"),
        F.coalesce(open_ & (age > gap), F.lit(False)).alias("now"),
    )
    turned = running(state, key, ["at"], bucket, lags={"before": F.col("stale")})
    turned = turned.where(F.col("stale") != F.coalesce("before", F.lit(False)))
    # Beginnings and ends alternate, beginning first.
    placed = with_position(turned, key, ["at"], bucket, "__i").withColumn("__span", bucket_of(F.col("__i"), 2))
    begins = F.col("stale")
    return placed.groupBy(*key, "__span").agg(
        F.max(F.when(begins, F.col("mark_at"))).alias("mark_at"),
        F.max(F.when(begins, F.col("at"))).alias("stale_from"),
        F.max(F.when(~begins, F.col("at"))).alias("stale_to"),
        F.max(F.when(begins, F.col("now").cast("int"))).alias("__now"),
    ).drop("__span")


def _counted_before(clock: DataFrame, moments: DataFrame, width: int) -> DataFrame:
    """``us, __n, __next``: how many instants of the clock lie before each moment, and the next."""
    ticks = clock.select(F.unix_micros("at").alias("us")).distinct().select("us", F.lit(1).alias("__tick"))
    asked = moments.where("us is not null").distinct().select("us", F.lit(0).alias("__tick"))
    both = ticks.unionByName(asked).withColumn("__all", F.lit(0))
    before = running(both, ["__all"], ["us", "__tick"], bucket_of(F.col("us"), width), sums={"__n": F.col("__tick")})
    back = before.withColumns({"__back": -F.col("us"), "__last": -F.col("__tick")})
    after = running(
        back, ["__all"], ["__back", "__last"], bucket_of(F.col("__back"), width),
        lasts={"__next": F.when(F.col("__tick") == 1, F.col("us"))},
    )
    return after.where("__tick = 0").select("us", "__n", "__next")


def short_positions(held: DataFrame) -> DataFrame:
    """Sells that leave a position below zero."""
    return held.where((F.col("side") == "sell") & (F.col("position") < -1e-12))


def warning_counts(warnings: DataFrame, keys: Sequence[str] = ("code", "instrument_id")) -> DataFrame:
    """Warnings merged per code and instrument, dated at the first."""
    return warnings.groupBy(*keys).agg(
        F.sum("occurrences").alias("occurrences"), F.min("at").alias("at")
    )


def trades(
    fills: DataFrame, *, keys: Sequence[str] = ("instrument_id",), order: Sequence[str],
    marks: DataFrame | None = None, width: int = LEDGER_BUCKET,
) -> DataFrame:
    """Flat-to-flat trades: from leaving zero to the return, a flip being both.

    A fill that crosses zero is split in two legs with its friction shared by size. An open
    trade is valued at ``marks`` (``keys, price``) or has null P&L.
    """
    return by_key_size(fills, keys, lambda rows, split: _trades(rows, keys, order, marks, _bucket(order[0], width, split)))


def _trades(
    fills: DataFrame, keys: Sequence[str], order: Sequence[str], marks: DataFrame | None, bucket: Column | None
) -> DataFrame:
    held = _positions(fills, keys, order, bucket)
    before, after, signed = F.col("position_before"), F.col("position"), F.col("signed")
    crosses = (before != 0) & (after != 0) & ((before > 0) != (after > 0))
    legs = F.when(
        crosses,
        F.array(
            F.struct(F.lit(0).alias("leg"), (-before).alias("applied"), before.alias("p0"),
                     F.lit(0.0).alias("p1")),
            F.struct(F.lit(1).alias("leg"), after.alias("applied"), F.lit(0.0).alias("p0"),
                     after.alias("p1")),
        ),
    ).otherwise(
        F.array(
            F.struct(F.lit(0).alias("leg"), signed.alias("applied"), before.alias("p0"),
                     after.alias("p1"))
        )
    )
    spread = F.coalesce("half_spread", F.lit(0.0)) + F.coalesce("slippage", F.lit(0.0))
    friction = F.col("fee") + F.col("quantity") * spread
    split = held.where(F.abs(signed) > FLAT).select(
        *keys, *order, "price", "reference_price", "quantity", friction.alias("friction"),
        F.inline(legs),
    )
    numbered = running(
        split, list(keys), [*order, "leg"], bucket,
        sums={"trade_no": (F.col("p0") == 0).cast("bigint")},
    )
    at, applied = F.col(order[0]), F.col("applied")
    entry = F.abs("p1") > F.abs("p0")
    place = F.struct(*order, "leg")
    grouped = numbered.groupBy(*keys, "trade_no").agg(
        F.min_by(F.signum("applied"), place).alias("sign"),
        F.min(at).alias("opened_at"),
        F.max(at).alias("last_at"),
        F.max_by("p1", place).alias("end_position"),
        F.max(F.abs("p1")).alias("peak_quantity"),
        F.sum(F.when(entry, F.abs(applied) * F.col("price")).otherwise(0.0)).alias("entry_notional"),
        F.sum(F.when(entry, F.abs(applied)).otherwise(0.0)).alias("entry_quantity"),
        F.sum(F.when(~entry, F.abs(applied) * F.col("price")).otherwise(0.0)).alias("exit_notional"),
        F.sum(F.when(~entry, F.abs(applied)).otherwise(0.0)).alias("exit_quantity"),
        F.sum(-applied * F.col("reference_price")).alias("flow"),
        F.sum(F.col("friction") * F.abs(applied) / F.col("quantity")).alias("costs"),
        F.count(F.lit(1)).alias("fill_count"),
    )
    if marks is None:
        grouped = grouped.withColumn("mark", F.lit(None).cast("double"))
    else:
        grouped = grouped.join(marks.select(*keys, F.col("price").alias("mark")), list(keys), "left")
    is_open = F.col("end_position") != 0
    left_qty = F.when(is_open, F.abs("end_position")).otherwise(0.0)
    gross = F.when(is_open, F.col("flow") + F.col("end_position") * F.col("mark")).otherwise(F.col("flow"))
    exit_price = F.when(
        is_open,
        F.try_divide(
            F.col("exit_notional") + left_qty * F.col("mark"), F.col("exit_quantity") + left_qty
        ),
    ).otherwise(F.try_divide(F.col("exit_notional"), F.col("exit_quantity")))
    entry_price = F.try_divide(F.col("entry_notional"), F.col("entry_quantity"))
    net = gross - F.col("costs")
    return grouped.select(
        *keys,
        "trade_no",
        F.when(F.col("sign") > 0, "long").otherwise("short").alias("direction"),
        "opened_at",
        F.when(~is_open, F.col("last_at")).alias("closed_at"),
        (elapsed("last_at", "opened_at") / SECOND).alias("duration_s"),
        "peak_quantity",
        entry_price.alias("entry_price"),
        exit_price.alias("exit_price"),
        "fill_count",
        gross.alias("gross_pnl"),
        "costs",
        net.alias("net_pnl"),
        F.try_divide(net, entry_price * F.col("peak_quantity")).alias("return_on_notional"),
        is_open.alias("is_open"),
    )


def last_marks(marks: DataFrame, *, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Latest price per key."""
    return marks.groupBy(*keys).agg(F.max_by("price", "at").alias("price"))
