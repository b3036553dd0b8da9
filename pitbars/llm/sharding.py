"""Size-balanced shards by sampled splitters, with DataFrame functions only.

Keys are sampled in proportion to their row's size, quantiles of the sample cut the key order
into ranges, and ranges that turn out overfull are sampled again and cut further. Rows of a
range are ordered in one task; running totals over all ranges give every row its exact place
in the global order, and with it a shard of equal size and a gapless slot. The sample only
decides how the work is split: the result is the same whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.operators.ordered import running
from pitbars.session import staged

OVERSAMPLE = 16
MIN_RANGES = 64
RANGE_ROWS = 2_000_000
OVERFULL = 2


def sortable(number: Column) -> Column:
    """A bigint as fixed-width text that sorts like the number; null sorts first."""
    flipped = number.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit(""))


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted splitters are at or below the key, found in two steps."""
    if not splitters:
        return F.lit(0).cast("bigint")
    width = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(s) for s in g]) for g in groups])
    group = F.size(F.filter(heads, lambda h: h <= key))
    within = F.size(F.filter(F.get(fine, group - 1), lambda s: s <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + within).cast("bigint")


def _sample(rows: DataFrame, chance: Column) -> list[str]:
    """Keys drawn by a hash of the key, so that a rerun draws the same."""
    even = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    return sorted(rows.where(even < chance).select("key").distinct().toArrow().column(0).to_pylist())


def split_points(rows: DataFrame, n_rows: int, total: int) -> list[str]:
    """Splitters of ``key, size`` rows. The sample has about ``OVERSAMPLE`` keys a range."""
    ranges = max(MIN_RANGES, -(-n_rows // RANGE_ROWS))
    drawn = _sample(rows, F.lit(float(OVERSAMPLE * ranges)) * F.col("size") / F.lit(float(max(total, 1))))
    points = sorted(set(drawn[OVERSAMPLE - 1 :: OVERSAMPLE]))
    most_rows, most_bytes = OVERFULL * max(n_rows / ranges, 1), OVERFULL * max(total / ranges, 1)
    while True:
        totals = (
            rows.withColumn("range", range_of(F.col("key"), points)).groupBy("range")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"),
                 F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        # A range of one key is repeated rows, which no splitter can part.
        over = [r for r in totals if (r.n > most_rows or r.b > most_bytes) and r.low < r.high]
        pieces = {r.range: max(2, round(max(r.n / most_rows, r.b / most_bytes) * OVERFULL)) for r in over}
        fresh: set[str] = set()
        for r in over:
            inside = rows.where((F.col("key") >= r.low) & (F.col("key") <= r.high))
            wanted = OVERSAMPLE * pieces[r.range]
            by_rows = F.lit(wanted / r.n) if r.n > most_rows else F.lit(float(wanted)) * F.col("size") / F.lit(float(r.b))
            keys = [k for k in _sample(inside, by_rows) if k > r.low]
            while not keys:  # the highest key is drawn in the end
                by_rows = 2 * by_rows
                keys = [k for k in _sample(inside, by_rows) if k > r.low]
            step = max(1, len(keys) // pieces[r.range])
            fresh.update(keys[step - 1 :: step])
        if fresh <= set(points):
            return points
        points = sorted(fresh | set(points))


def assign_shards(
    df: DataFrame, row_id: Column, key: Column, size: Column, shards: int = 8, **extra: Column
) -> DataFrame:
    """``id, size, shard, slot`` and the ``extra`` columns for every row of ``df``.

    Args:
        key: text whose order the shards follow; rows of one key stay side by side, and are
            parted only where a shard is full. Ids part equal keys.
        size: what is balanced, at least 1 a row.

    Rows are numbered by ``(key, id)``; a row goes to the shard in which the middle of its
    size falls, so shards differ by about one row's size. Repeated rows each get a slot, an
    empty table gives no rows. Only the named expressions are read, so other columns may have
    any name. Stores a narrow copy (no texts) and its placing while the plan is being built.
    """
    named = {"id": row_id, "size": size.cast("bigint"), **extra}
    columns = list(named)
    rows = df.select(
        *[c.alias(n) for n, c in named.items()],
        F.concat(F.coalesce(key, F.lit("")), F.lit(":"), sortable(row_id)).alias("key"),
    )
    rows = staged(rows, "shard-rows")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    total = int(count.b or 0)
    points = split_points(rows, int(count.n), total)
    placed = running(
        rows, [], ["key"], range_of(F.col("key"), points),
        sums={"end": F.col("size"), "place": F.lit(1).cast("bigint")},
    )
    shard = F.least(
        F.lit(shards - 1), F.floor((2 * F.col("end") - F.col("size")) * shards / F.lit(2 * max(total, 1)))
    )
    placed = staged(placed.select(*columns, "place", shard.cast("int").alias("shard")), "shard-places")
    # At most one row a shard.
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        *columns, "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, *, id_name: str, files: int = 8) -> None:
    """Write the rows as ``shard=…`` folders, each in slot order over ``files`` files."""
    spots = assigned.select(F.col("id").alias(id_name), "shard", "slot")
    joined = df.join(spots, id_name)
    shards = max(1, spots.select("shard").distinct().count())
    joined.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
