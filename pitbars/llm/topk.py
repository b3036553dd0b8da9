"""The first rows of every key, without any key's rows meeting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts a key is first cut into; each part hands on at most the rows wanted of the whole key.
PARTS = 64


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, spread: Column, place: str = "place") -> DataFrame:
    """Rows with ``place`` up to ``n`` of every key along ``order``.

    Rows are ranked within ``(key, part)`` first, where ``spread`` says which part a row is
    in, and what is left within the key: at most ``PARTS * n`` rows of it, however many it has.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(PARTS))
    first = df.withColumn("__part", part).withColumn(
        "__place", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    ).where(F.col("__place") <= n).drop("__part", "__place")
    return first.withColumn(
        place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where(F.col(place) <= n)
