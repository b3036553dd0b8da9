"""Ranks and means across instruments at each instant.

Values are counted and cut into ranges by a sample of them, so even an instant that holds a
large part of all rows is ranked by many tasks, however close or repeated its values are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.operators.ordered import group_totals, hash_spread, ranged, running
from pitbars.types import require_columns

METHODS = ("average", "min", "max", "dense", "ordinal")


@dataclass(frozen=True)
class CrossRank:
    column: str
    min_members: int = 2
    pct: bool = True
    method: str = "average"
    descending: bool = False
    name: str | None = None

    def __post_init__(self) -> None:
        if self.min_members < 2:
            raise ValueError("min_members must be at least 2")
        if self.method not in METHODS:
            raise ValueError(f"unknown rank method {self.method!r}; known: {METHODS}")

    @property
    def output(self) -> str:
        return self.name or f"{self.column}_xrank"


@dataclass(frozen=True)
class CrossMean:
    column: str
    min_members: int = 2
    name: str | None = None

    def __post_init__(self) -> None:
        if self.min_members < 2:
            raise ValueError("min_members must be at least 2")

    @property
    def output(self) -> str:
        return self.name or f"{self.column}_xmean"


def _rank(df: DataFrame, base: DataFrame, rank: CrossRank, at: str, tiebreak: str) -> DataFrame:
    """Add one rank column; null values get a null rank and count for nobody.

    Ranks that ties share are found on a table of distinct values, with their counts summed up
    along ranges of values, and meet the rows by an equi-join. Ordinal ranks tell ties apart,
    so the rows themselves are cut into ranges of value and tie-break. Values are counted on
    ``base``, not the frame built so far, so several ranks read the source once each.
    """
    value = F.col(rank.column).cast("double")
    if rank.descending:
        value = -value
    if rank.method == "ordinal":
        work = df.withColumn("__v", value).withColumn("__missing", F.col("__v").isNull().cast("int"))
        cut = ranged(work, [at], ["__missing", "__v", tiebreak])
        known = F.col("__v").isNotNull().cast("bigint")
        placed = running(
            cut, [at], ["__missing", "__v", tiebreak], F.col("__part"), sums={"__place": known}
        )
        joined = group_totals(placed, [at], F.col("__part"), sums={"__members": known})
        place = F.col("__place").cast("double")
    else:
        counted = base.select(at, value.alias("__v")).where(F.col("__v").isNotNull())
        counts = ranged(counted.groupBy(at, "__v").agg(F.count(F.lit(1)).alias("__n")), [at], ["__v"])
        upto = running(
            counts, [at], ["__v"], F.col("__part"),
            sums={"__upto": F.col("__n"), "__distinct": F.lit(1).cast("bigint")},
        )
        known = group_totals(upto, [at], F.col("__part"), sums={"__members": F.col("__n")})
        last = F.col("__upto").cast("double")
        first = last - F.col("__n") + 1
        place = {
            "min": first, "max": last, "average": (first + last) / 2, "dense": F.col("__distinct").cast("double")
        }[rank.method]
        placed = known.select(F.col(at).alias("__at"), F.col("__v").alias("__value"), place.alias("__place"), "__members")
        work = df.withColumn("__v", value)
        joined = work.join(placed, (F.col(at) == F.col("__at")) & (F.col("__v") == F.col("__value")), "left")
        place = F.col("__place")
    result = F.try_divide(place, F.col("__members").cast("double")) if rank.pct else place
    enough = F.col("__v").isNotNull() & (F.col("__members") >= rank.min_members)
    return joined.withColumn(rank.output, F.when(enough, result)).select(*df.columns, rank.output)


def cross_section(
    frame: DataFrame,
    features: Sequence[CrossRank | CrossMean],
    *,
    at: str = "bar_start",
    entity: str = "instrument_id",
) -> DataFrame:
    """Add cross-sectional columns and lift availability to the slowest member's.

    A batch at an instant is complete only when every member is in, so ``available_at``
    becomes the maximum over the instant.
    """
    if not features:
        raise ValueError("no cross-sectional features requested")
    require_columns(frame, [entity, at, "available_at", *{f.column for f in features}], "cross-section")
    names = [f.output for f in features]
    if len(set(names)) != len(names) or set(names) & set(frame.columns):
        raise ValueError(f"output names {names} repeat or collide with the frame")
    means = [f for f in features if isinstance(f, CrossMean)]
    sums = {f"__s{i}": F.col(m.column).cast("double") for i, m in enumerate(means)}
    sums |= {f"__c{i}": F.col(m.column).isNotNull().cast("bigint") for i, m in enumerate(means)}
    out = group_totals(
        frame,
        [at],
        hash_spread(entity),
        sums=sums,
        maxs={"__ready": F.col("available_at")},
    )
    for i, m in enumerate(means):
        enough = F.col(f"__c{i}") >= m.min_members
        out = out.withColumn(
            m.output, F.when(enough, F.try_divide(F.col(f"__s{i}"), F.col(f"__c{i}").cast("double")))
        )
    out = out.withColumn("available_at", F.col("__ready")).drop("__ready", *sums)
    for f in features:
        if isinstance(f, CrossRank):
            out = _rank(out, frame, f, at, entity)
    kept = [c for c in frame.columns if c not in (entity, at, "available_at")]
    return out.select(entity, at, *kept, *names, "available_at")
