"""Ordered computations that never put a whole key into one task.

A plain ``Window.partitionBy(instrument)`` gives one task the full history of an
instrument, and one hot instrument then decides the run time. Everything here splits a key
into contiguous buckets of its order instead:

* :func:`running` computes running sums, last values, maxima and lags. A light pre-pass
  aggregates each bucket (map-side combined, so its shuffle is one row per key and bucket
  and map task), a window over those few rows gives each bucket its carry-in, and the
  carry joins the data as one extra row at the front of its bucket. The data is shuffled
  once, by ``(key, bucket)``.
* :func:`rolling` serves row frames with a bounded lookback. Exact row positions come from
  :func:`running`; rows are then cut into chunks of a fixed row count and the last
  ``lookback`` rows of each chunk are copied to the next. The result equals the unsplit
  window for any frame that reaches at most ``lookback`` rows back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitbars.functions.scalars import bucket_of
from pitbars.session import staged

CHUNK_ROWS = 8192
#: A key of more rows is split; at most one key in so many rows of a table is.
LARGE_KEY = 100_000

_BUCKET = "__bucket"
_DATA = "__is_data"


def by_key_size(
    df: DataFrame, keys: Sequence[str], build: Callable[[DataFrame, bool], DataFrame],
    *, counted: DataFrame | None = None,
) -> DataFrame:
    """``build(rows, split)`` for the rows of large keys, to be split, and for all others.

    Splitting costs a pre-pass and a carried row per key and bucket, as much as the data itself
    where keys are short. Short keys are therefore taken whole: one shuffle by key serves all
    scans and groupings of ``build``. ``counted`` is what to count where that is cheaper than
    ``df``, a table with rows for every key. The list of large keys is short by definition.
    """
    names = [f"__large{i}" for i in range(len(keys))]
    sizes = (df if counted is None else counted).select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    large = sizes.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LARGE_KEY)
    large = F.broadcast(large.drop("__n"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    whole = df.join(large, same, "left_anti")
    return build(whole, False).unionByName(build(df.join(large, same, "left_semi"), True))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    previous_lasts: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key in ``order``.

    Args:
        order: columns forming a total order within a key (ascending, nulls first).
        bucket: non-decreasing along ``order`` within a key; decides the split. None takes
            keys whole, for those known to be short (:func:`by_key_size`).
        sums: running totals including the row; null counts as zero.
        lasts: last non-null value up to and including the row.
        previous_lasts: last non-null value strictly before the row.
        maxs: running maximum including the row.
        lags: the value on the row just before, null included.
        firsts: first non-null value up to and including the row.
    """
    sums, lasts, previous_lasts = dict(sums or {}), dict(lasts or {}), dict(previous_lasts or {})
    maxs, lags, firsts = dict(maxs or {}), dict(lags or {}), dict(firsts or {})
    columns = df.columns
    if bucket is None:
        return _running_whole(df, keys, order, sums, lasts, previous_lasts, maxs, lags, firsts)
    work = df.withColumns(
        {
            _BUCKET: bucket,
            **{f"__s_{n}": e for n, e in sums.items()},
            **{f"__l_{n}": F.when(e.isNotNull(), F.struct(e.alias("v"))) for n, e in lasts.items()},
            **{
                f"__p_{n}": F.when(e.isNotNull(), F.struct(e.alias("v")))
                for n, e in previous_lasts.items()
            },
            **{f"__m_{n}": e for n, e in maxs.items()},
            **{f"__g_{n}": F.struct(e.alias("v")) for n, e in lags.items()},
            **{
                f"__f_{n}": F.when(e.isNotNull(), F.struct(e.alias("v")))
                for n, e in firsts.items()
            },
        }
    )
    held = [f"__l_{n}" for n in lasts] + [f"__p_{n}" for n in previous_lasts]
    held += [f"__g_{n}" for n in lags]
    heads = [f"__f_{n}" for n in firsts]
    position = F.struct(*order)

    totals = work.groupBy(*keys, _BUCKET).agg(
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in held],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in heads],
        *[F.max(f"__m_{n}").alias(f"__m_{n}") for n in maxs],
    )
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = totals.select(
        *keys,
        _BUCKET,
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__s_{n}") for n in sums],
        *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in held],
        *[F.first(c, ignorenulls=True).over(earlier).alias(c) for c in heads],
        *[F.max(f"__m_{n}").over(earlier).alias(f"__m_{n}") for n in maxs],
        F.lit(0).alias(_DATA),
    )
    joined = work.withColumn(_DATA, F.lit(1)).unionByName(carry, allowMissingColumns=True)

    spot = Window.partitionBy(*keys, _BUCKET).orderBy(_DATA, *order)
    upto = spot.rowsBetween(Window.unboundedPreceding, 0)
    before = spot.rowsBetween(Window.unboundedPreceding, -1)
    return (
        joined.withColumns(
            {
                **{n: F.coalesce(F.sum(f"__s_{n}").over(upto), F.lit(0)) for n in sums},
                **{n: F.last(f"__l_{n}", ignorenulls=True).over(upto)["v"] for n in lasts},
                **{
                    n: F.last(f"__p_{n}", ignorenulls=True).over(before)["v"]
                    for n in previous_lasts
                },
                **{n: F.max(f"__m_{n}").over(upto) for n in maxs},
                **{n: F.lag(f"__g_{n}", 1).over(spot)["v"] for n in lags},
                **{n: F.first(f"__f_{n}", ignorenulls=True).over(upto)["v"] for n in firsts},
            }
        )
        .where(F.col(_DATA) == 1)
        .select(*columns, *sums, *lasts, *previous_lasts, *maxs, *lags, *firsts)
    )


def _running_whole(df, keys, order, sums, lasts, previous_lasts, maxs, lags, firsts) -> DataFrame:
    spot = Window.partitionBy(*keys).orderBy(*order)
    upto = spot.rowsBetween(Window.unboundedPreceding, 0)
    before = spot.rowsBetween(Window.unboundedPreceding, -1)
    made = {
        **{n: F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in sums.items()},
        **{n: F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()},
        **{n: F.last(e, ignorenulls=True).over(before) for n, e in previous_lasts.items()},
        **{n: F.max(e).over(upto) for n, e in maxs.items()},
        **{n: F.lag(e, 1).over(spot) for n, e in lags.items()},
        **{n: F.first(e, ignorenulls=True).over(upto) for n, e in firsts.items()},
    }
    return df.select(*df.columns, *[e.alias(n) for n, e in made.items()])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__part") -> DataFrame:
    """Store ``df`` range-partitioned by ``(keys, order)``, with its partition's number.

    Spark draws a sample and chooses the boundaries, so a key is cut wherever its rows lie:
    values close to each other are told apart like any others. The number does not decrease
    along ``order`` within a key and serves :func:`running` as its bucket. Rows equal in all
    of ``order`` stay together; count them first where there may be many. The result is
    stored, because a second sample would give other boundaries.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order)
    return staged(cut.withColumn(name, F.spark_partition_id().cast("bigint")), "ranged")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, name: str = "pos"
) -> DataFrame:
    """Exact 0-based row position per key along ``order``."""
    counted = running(df, keys, order, bucket, sums={name: F.lit(1).cast("bigint")})
    return counted.withColumn(name, F.col(name) - 1)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lookback: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    first: Sequence[Callable[[WindowSpec], Mapping[str, Column]]] = (),
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add windowed columns whose frames reach at most ``lookback`` rows back.

    ``build`` receives the ordered window and returns the new columns; the builders in
    ``first`` add columns over the same window, one after the other, for later ones to use. With ``chunk_rows=None`` the key
    is not split: one shuffle less, for keys known to be short.
    """
    if chunk_rows is None:
        plain = Window.partitionBy(*keys).orderBy(*order)
        begun = df
        for stage in first:
            begun = begun.withColumns(dict(stage(plain)))
        return begun.withColumns(dict(build(plain)))
    size = max(chunk_rows, lookback, 1)
    placed = with_position(df, keys, order, bucket, "__pos")
    home = bucket_of(F.col("__pos"), size)
    near_end = F.pmod(F.col("__pos"), F.lit(size)) >= size - lookback
    spread = placed.withColumn("__home", home).withColumn(
        "__chunk",
        F.explode(
            F.when(near_end, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))
        ),
    )
    spec = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    begun = spread
    for stage in first:
        begun = begun.withColumns(dict(stage(spec)))
    return (
        begun.withColumns(dict(build(spec)))
        .where(F.col("__chunk") == F.col("__home"))
        .drop("__pos", "__home", "__chunk")
    )


@dataclass(frozen=True)
class Fold:
    """A left fold whose steps compose, so that a stretch of rows is again a step.

    A step is a row of a float matrix, and so is a state. All functions work on whole columns:
    ``step`` makes the steps of a batch from its input columns, ``compose`` joins two steps row
    by row, the first argument coming first, and ``apply`` takes states over steps.
    ``identity`` is the step that changes nothing.
    """

    inputs: tuple[str, ...]
    start: tuple[float, ...]
    identity: tuple[float, ...]
    step: Callable[..., np.ndarray]
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray]
    apply: Callable[[np.ndarray, np.ndarray], np.ndarray]


def affine_fold(
    inputs: Sequence[str], start: Sequence[float], step: Callable[..., tuple[np.ndarray, np.ndarray]]
) -> Fold:
    """A fold of steps ``state -> A state + b`` on state vectors of any size.

    ``step`` makes ``A`` (rows × size × size) and ``b`` (rows × size) from the input columns.
    Composing two steps multiplies their matrices.
    """
    size = len(start)

    def parts(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return steps[:, : size * size].reshape(-1, size, size), steps[:, size * size :]

    def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([a.reshape(len(a), -1), b], axis=1)

    def compose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a1, b1), (a2, b2) = parts(x), parts(y)
        return packed(a2 @ a1, np.einsum("nij,nj->ni", a2, b1) + b2)

    def apply(states: np.ndarray, steps: np.ndarray) -> np.ndarray:
        a, b = parts(steps)
        return np.einsum("nij,nj->ni", a, states) + b

    return Fold(
        inputs=tuple(inputs), start=tuple(start),
        identity=(*np.eye(size).reshape(-1), *np.zeros(size)),
        step=lambda *columns: packed(*step(*columns)), compose=compose, apply=apply,
    )


def _scan(fold: Fold, steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per row, the composition of all steps of its segment up to and including it.

    Rows look back 1, 2, 4, ... places, as far as their segment goes.
    """
    rows = np.arange(len(steps))
    begin = np.maximum.accumulate(np.where(starts, rows, 0))
    out, reach = steps, 1
    longest = int((rows - begin).max(initial=0))
    while reach <= longest:
        joined = out.copy()
        far = np.flatnonzero(rows - begin >= reach)
        joined[far] = fold.compose(out[far - reach], out[far])
        out, reach = joined, reach * 2
    return out


def _shifted(fold: Fold, scanned: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What comes before each row of its segment: the scan one row earlier."""
    before = np.empty_like(scanned)
    before[1:] = scanned[:-1]
    before[starts] = fold.identity
    if len(before):
        before[0] = fold.identity
    return before


def _columns(batch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def fold_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, fold: Fold,
    *, before: str = "before", after: str = "after",
) -> DataFrame:
    """Run a :class:`Fold` along ``order`` and add the state before and after each row.

    For folds that no built-in aggregate expresses. Rows are shuffled and sorted by
    ``(key, bucket)`` and streamed through Arrow batches, so memory does not depend on how
    many rows a key has. A first pass composes each bucket's steps, one small row per bucket
    is chained per key, and a second pass starts every bucket from its state. Without a
    ``bucket`` keys are whole and the second pass is the only one.
    """
    columns, kinds = df.columns, dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    group = [*keys, _BUCKET]
    parts = [f"__s{i}" for i in range(len(fold.identity))]
    held = [f"__state{i}" for i in range(len(fold.start))]
    befores = [before] if isinstance(before, str) else list(before)
    afters = [after] if isinstance(after, str) else list(after)
    start = np.array([fold.start], dtype=float)
    work = df if bucket is None else df.withColumn(_BUCKET, bucket)

    def summarise(batches):
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _group_starts(batch, group, last)
            number = 0 if starts[0] else number + 1
            scanned = _scan(fold, fold.step(*_columns(batch, fold.inputs)), starts)
            ends = np.flatnonzero(np.append(starts[1:], True))
            # A bucket that continues from the batch before goes on under the next number.
            numbers = np.zeros(len(ends), dtype=np.int64)
            numbers[0] = number
            if len(ends) > 1:
                number = 0
            picked = batch.select(group).take(pa.array(ends))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(numbers), *[pa.array(c) for c in scanned[ends].T]],
                names=[*group, "__part", *parts],
            )

    def chain(batches):
        last_key, last_group, state = None, None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            new_key, last_key = _group_starts(batch, list(keys), last_key)
            new_group, last_group = _group_starts(batch, group, last_group)
            steps = np.stack(_columns(batch, parts), axis=1)
            scanned = _scan(fold, steps, new_key)
            carried = np.cumsum(new_key) == 0
            base = np.where(carried[:, None], state, start)
            states = fold.apply(base, _shifted(fold, scanned, new_key))
            state = fold.apply(base[-1:], scanned[-1:])
            rows = np.flatnonzero(new_group)
            picked = batch.select(group).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *[pa.array(c) for c in states[rows].T]], names=[*group, *held]
            )

    def trace_whole(batches):
        last, state = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _group_starts(batch, list(keys), last)
            scanned = _scan(fold, fold.step(*_columns(batch, fold.inputs)), starts)
            carried = np.cumsum(starts) == 0
            base = np.where(carried[:, None], state, start)
            entered, left = fold.apply(base, _shifted(fold, scanned, starts)), fold.apply(base, scanned)
            state = left[-1:]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(columns).columns, *[pa.array(c) for c in (*entered.T, *left.T)]],
                names=[*columns, *befores, *afters],
            )

    def trace(batches):
        state = start
        for batch in batches:
            if not batch.num_rows:
                continue
            # A bucket begins with a row that only brings its state.
            data = batch.column(_DATA).to_numpy(zero_copy_only=False) == 1
            steps = np.tile(np.array(fold.identity), (len(data), 1))
            steps[data] = fold.step(*_columns(batch.filter(pa.array(data)), fold.inputs))
            scanned = _scan(fold, steps, ~data)
            brought = np.stack(_columns(batch, held), axis=1)
            begin = np.maximum.accumulate(np.where(~data, np.arange(len(data)), -1))
            base = np.where(begin[:, None] < 0, state, brought[np.maximum(begin, 0)])
            entered, left = fold.apply(base, _shifted(fold, scanned, ~data)), fold.apply(base, scanned)
            state = left[-1:]
            kept = batch.filter(pa.array(data)).select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(c) for c in (*entered[data].T, *left[data].T)]],
                names=[*columns, *befores, *afters],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    schema += "".join(f", {c} DOUBLE" for c in (*befores, *afters))
    if bucket is None:
        return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(trace_whole, schema)
    slim = work.select(*group, *[c for c in order if c not in group], *fold.inputs)
    ordered = slim.repartition(*group).sortWithinPartitions(*group, *order)
    summed = ordered.mapInArrow(
        summarise,
        f"{head}, {_BUCKET} BIGINT, __part BIGINT, " + ", ".join(f"{c} DOUBLE" for c in parts),
    )
    states = (
        summed.repartition(*keys)
        .sortWithinPartitions(*group, "__part")
        .mapInArrow(chain, f"{head}, {_BUCKET} BIGINT, " + ", ".join(f"{c} DOUBLE" for c in held))
    )
    both = work.withColumn(_DATA, F.lit(1)).unionByName(
        states.withColumn(_DATA, F.lit(0)), allowMissingColumns=True
    )
    return (
        both.repartition(*group)
        .sortWithinPartitions(*group, _DATA, *order)
        .mapInArrow(trace, schema)
    )


def _group_starts(batch, group: Sequence[str], last):
    """Per row, whether it starts a group; and the batch's last group for the next call."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    for c in group:
        column = batch.column(c)
        if n > 1:
            moved = pc.not_equal(column.slice(1), column.slice(0, n - 1))
            starts[1:] |= moved.to_numpy(zero_copy_only=False)
    first = tuple(batch.column(c)[0].as_py() for c in group)
    starts[0] = first != last
    return starts, tuple(batch.column(c)[n - 1].as_py() for c in group)


def group_totals(
    df: DataFrame,
    keys: Sequence[str],
    spread: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Attach per-key totals to every row without gathering a key in one task.

    Rows are grouped by ``(key, spread)``, the few partial rows of a key are totalled by a
    window, and each row meets the total through its own ``(key, spread)`` partition.
    """
    sums, maxs = dict(sums or {}), dict(maxs or {})
    work = df.withColumn("__spread", spread)
    partial = work.groupBy(*keys, "__spread").agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max(e).alias(n) for n, e in maxs.items()],
    )
    whole = Window.partitionBy(*keys)
    totals = partial.select(
        *keys,
        "__spread",
        *[F.sum(n).over(whole).alias(n) for n in sums],
        *[F.max(n).over(whole).alias(n) for n in maxs],
    )
    return work.join(totals, [*keys, "__spread"]).drop("__spread")


def hash_spread(column: str, width: int = 64) -> Column:
    """A stable spread value for :func:`group_totals`."""
    return F.pmod(F.xxhash64(column), F.lit(width)).cast("int")
