"""A number for every row of a stored table, whatever its ids are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.graph import join_checked
from pitbars.session import staged

_FILE_BITS = 36


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a bigint that tells its rows apart: the file's number and the place in it.

    Both are facts of the stored files, so every reading gives a row the same number, however
    the files are split among tasks. A table that is not read from files is stored first.
    Only the list of files is numbered in one task, one row a file.
    """
    try:
        placed = _placed(df)
    except AnalysisException:
        placed = _placed(staged(df, "rows"))
    files = staged(placed.select("__file").distinct(), "files")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__file")).cast("bigint")
    files = staged(files.withColumn("__number", number), "files")
    joined = join_checked(placed, files, ["__file"], "inner")
    return joined.withColumn(name, F.col("__number") * (1 << _FILE_BITS) + F.col("__index")).drop(
        "__file", "__index", "__number"
    )


def _placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
