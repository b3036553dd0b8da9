"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's rows are shuffled (by hash, anew for each repeat) and laid end to end as one
stream of words, cut into blocks of equal length. The schedule is a list of slots. Slot ``i``
maps the ``i``-th van der Corput point through the sources' cumulative shares, so any stretch
of slots holds the sources close to their shares; the slot's rank within its source names the
block that fills it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.operators.ordered import running
from pitbars.session import staged

BLOCK_WORDS = 4096
MIN_SLOTS = 16384
#: Sources a catalogue may have.
MAX_SOURCES = 10_000
_BITS = 40
_BUCKET_ROWS = 200_000
_SLOTS_A_BUCKET = 65536

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fill_targets(
    sizes: Sequence[int], weights: Sequence[float], *, share: float = 1.5, most: float = 2.0
) -> list[float]:
    """Split ``share`` of all sizes by weight, no target above ``most`` times its own size.

    What a capped source cannot take is shared again by weight until none is above: sources
    are capped in the order of cap per weight while the common level exceeds their cap.
    """
    left, weight = share * sum(sizes), float(sum(weights))
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for place, i in enumerate(order):
        cap = most * sizes[i]
        if cap * weight > weights[i] * left:
            for j in order[place:]:
                targets[j] = weights[j] * (left / weight)
            break
        targets[i] = float(cap)
        left -= cap
        weight -= weights[i]
    return targets


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per input row; ``slots``: the schedule; ``pieces``: what fills it."""

    docs: DataFrame
    slots: DataFrame
    pieces: DataFrame
    sources: tuple[tuple[str | None, int, float], ...]
    block_words: int


def mix(
    df: DataFrame, row_id: Column, source: Column, size: Column, *,
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2,
) -> Mix:
    """Schedule ``share`` of all words over the sources.

    Sources sort by code point with null last and take ``weights`` in turn. A source's stream
    is its rows ``most`` times over; its first ``floor(target)`` words are scheduled, so no row
    is taken more than ``most`` times. ``taken`` in ``docs`` is the sum of a row's pieces.

    Rows of size 0 are taken 0 times; rows of one id are told apart; an empty table gives an
    empty mix. The table of sources (a name and a size each) is read by the driver and sent to
    every task: more than ``MAX_SOURCES`` are refused, as a key with a value per row is no
    catalogue. Equal ids are taken in the order of their sizes, so that the files' layout does
    not matter. Stores a narrow
    copy of the rows, without texts, and the pieces.
    """
    spark = df.sparkSession
    rows = df.select(row_id.alias("id"), source.alias("source"), size.cast("bigint").alias("size"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    found = staged(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    if (n_sources := found.count()) > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; a mix takes a catalogue of at most {MAX_SOURCES}")
    found = found.collect()
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share=share, most=most)
    quotas = [int(t) for t in targets]
    block = max(1, min(BLOCK_WORDS, -(-sum(quotas) // MIN_SLOTS)))
    wanted = [-(-q // block) for q in quotas]

    table = spark.createDataFrame(
        [(i, r.source, s, t, q) for i, (r, s, t, q) in enumerate(zip(found, sizes, targets, quotas))],
        "src int, name string, source_size bigint, target double, quota bigint",
    )
    docs = rows.join(
        F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))  # as long as the catalogue
    ).drop("name")

    pieces = staged(_pieces(docs, sum(int(r.n) for r in found), block, most), "mix-pieces")
    slots = schedule(spark, wanted)
    filled = pieces.join(slots, ["src", "rank"])
    taken = filled.groupBy("row").agg(F.sum("words").alias("taken"))
    docs = docs.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    sources = tuple((r.source, s, t) for r, s, t in zip(found, sizes, targets))
    return Mix(docs, slots, filled, sources, block)


def _pieces(docs: DataFrame, n_rows: int, block: int, most: int) -> DataFrame:
    """Rows cut at block borders: ``src, rank, row, id, start, words`` within the quota.

    ``start`` is the first word's place in its row. Places in the stream are running totals
    in hash order; a source is split into buckets of that order, so no task holds a source.
    """
    buckets = max(256, min(65536, -(-n_rows // _BUCKET_ROWS)))
    laps = docs.where("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    laps = laps.withColumn(
        "order", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("lap").cast("string")))
    )
    bucket = F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("bigint") * buckets / 65536)
    placed = running(laps, ["src", "lap"], ["order", "id", "size", "row"], bucket, sums={"end": F.col("size")})
    begin = F.col("lap") * F.col("source_size") + F.col("end") - F.col("size")
    placed = placed.withColumn("begin", begin).where("begin < quota")
    stop = F.least(F.col("begin") + F.col("size"), F.col("quota"))
    cut = placed.withColumn("stop", stop).withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block)))
    )
    first = F.greatest("begin", F.col("rank") * block)
    last = F.least("stop", (F.col("rank") + 1) * block)
    return cut.select(
        "src", "rank", "row", "id", (first - F.col("begin")).alias("start"), (last - first).alias("words")
    )


def schedule(spark, wanted: Sequence[int]) -> DataFrame:
    """``slot, src, rank`` with exactly ``wanted[src]`` ranks for each source.

    Points beyond a source's share are passed over. What the points leave short, a few slots
    a source at most, closes the schedule.
    """
    total = sum(wanted)
    shape = "slot bigint, src int, rank bigint"
    if not total:
        return spark.createDataFrame([], shape)
    whole, borders, run = 1 << _BITS, [], 0
    for n in wanted[:-1]:
        run += n
        borders.append(whole * run // total)
    point = F.conv(F.reverse(F.lpad(F.bin("id"), _BITS, "0")), 2, 10).cast("bigint")
    src = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in borders]), lambda b: b <= F.col("point"))) if borders else F.lit(0)
    drawn = spark.range(total).withColumn("point", point).select(F.col("id").alias("slot"), src.cast("int").alias("src"))
    ranked = running(
        drawn, ["src"], ["slot"], F.floor(F.col("slot") / _SLOTS_A_BUCKET),
        sums={"rank": F.lit(1).cast("bigint")},
    ).withColumn("rank", F.col("rank") - 1)
    limit = F.get(F.array(*[F.lit(n).cast("bigint") for n in wanted]), F.col("src"))
    have = {r.src: int(r["count"]) for r in drawn.groupBy("src").count().collect()}
    short, slot = [], total
    for i, n in enumerate(wanted):
        lack = n - have.get(i, 0)
        if lack > 0:
            short.append((slot, i, n - lack, lack))
            slot += lack
    rest = spark.createDataFrame(short, "slot bigint, src int, rank bigint, lack bigint").withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lack") - 1))
    ).select(F.col("slot") + F.col("step"), "src", F.col("rank") + F.col("step"))
    return ranked.where(F.col("rank") < limit).select("slot", "src", "rank").union(rest)
