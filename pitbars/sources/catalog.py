"""Immutable bar datasets with metadata tables, pruned point-in-time reads, and SQL views.

Under a root that every executor reaches: ``bars/dataset=<id>/date=<day>/*.parquet``, and
Parquet metadata under ``datasets``, ``dataset_partitions`` and ``dataset_instruments``.
The row in ``datasets`` is written last, so a dataset is visible only when complete.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.functions.scalars import instant
from pitbars.operators.resample import latest_revisions
from pitbars.session import prepare, staged
from pitbars.sources.digests import BAR_CONTENT, digest, digest_text
from pitbars.types import BAR_COLUMNS, BAR_SCHEMA, utc

log = logging.getLogger(__name__)

STATS = ("row_count", "min_bar_start", "max_bar_start", "min_available_at", "max_available_at")
DATASET_SCHEMA = "identity STRING, bar_size STRING, content_digest STRING, row_count BIGINT"


def dataset_id(identity: Mapping) -> str:
    """Id from everything that decides the content: sources, policy, range, instruments."""
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"), default=str)
    return "ds_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def partition_stats(bars: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Row count and time bounds per day (or file)."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("bar_start").alias("min_bar_start"),
        F.max("bar_start").alias("max_bar_start"),
        F.min("available_at").alias("min_available_at"),
        F.max("available_at").alias("max_available_at"),
    )


class BarCatalog:
    """Datasets under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def _path(self, table: str, dataset: str) -> str:
        return f"{self.root}/{table}/dataset={dataset}"

    def _table(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException:
            return None

    # -- writing ---------------------------------------------------------------------------

    def write(self, bars: DataFrame, identity: Mapping, *, hash_files: bool = False) -> tuple[str, bool]:
        """Write a dataset once. Returns its id and whether an equal one existed already.

        ``bars`` is read three times (digest, sampling, write); hand in a checkpointed or
        stored frame when it is costly. Rows are range-partitioned by day, instrument and
        time, so a crowded day or instrument spreads over several files and row-group
        statistics stay selective.
        """
        dataset = dataset_id(identity)
        content = digest_text(bars.select(*BAR_COLUMNS), BAR_CONTENT)
        existing = self.describe(dataset)
        if existing is not None:
            if existing["content_digest"] != content:
                raise ValueError(f"dataset {dataset} exists with other content")
            return dataset, True
        dated = bars.select(*BAR_COLUMNS).withColumn("date", F.to_date("bar_start"))
        order = ["date", "instrument_id", "bar_start", "revision"]
        (
            dated.repartitionByRange(*order[:3])
            .sortWithinPartitions(*order)
            .write.partitionBy("date")
            .option("compression", "zstd")
            # Data without a ``datasets`` row is the rest of a failed attempt, never a dataset.
            .mode("overwrite")
            .parquet(self._path("bars", dataset))
        )
        # One reading of what was stored; the metadata tables are sums of it.
        held = staged(
            partition_stats(self._stored(dataset), ["date", "instrument_id", "bar_size"]), "dataset-stats"
        )
        stats = held.groupBy("date").agg(
            F.sum("row_count").alias("row_count"),
            *[F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in STATS[1:]],
        )
        if hash_files:
            stats = stats.join(self.file_hashes(dataset), "date", "left")
        stats.write.mode("overwrite").parquet(self._path("dataset_partitions", dataset))
        held.groupBy("date", "instrument_id").agg(F.sum("row_count").alias("row_count")).write.mode("overwrite").parquet(
            self._path("dataset_instruments", dataset)
        )
        total = held.agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.min("bar_size").alias("lo"), F.max("bar_size").alias("hi")
        ).first()
        if total["lo"] != total["hi"]:
            raise ValueError(f"a dataset has one bar size, found {total['lo']} and {total['hi']}")
        text = json.dumps(identity, sort_keys=True, default=str)
        self.spark.createDataFrame(
            [(text, total["lo"], content, total["rows"])], DATASET_SCHEMA
        ).coalesce(1).write.mode("errorifexists").parquet(self._path("datasets", dataset))
        return dataset, False

    def file_hashes(self, dataset: str) -> DataFrame:
        """Bytes and a digest of the files of each day.

        Files are read as runs of bytes between newlines, which Spark splits like any text, so
        a file of any size is read by many tasks and no row holds more than one run. The digest
        sums the runs' hashes with their lengths; with the number of bytes it tells any change
        but a new order of whole runs, which the content digest finds.
        """
        pieces = (
            self.spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").text(self._path("bars", dataset))
        )
        day = F.to_date(F.regexp_extract("_metadata.file_path", r"date=(\d{4}-\d\d-\d\d)", 1))
        run = F.col("value").cast("binary")
        hashed = pieces.select(
            day.alias("date"), (F.octet_length(run) + 1).cast("bigint").alias("n"),
            F.xxhash64(run).cast("decimal(20,0)").alias("a"), F.xxhash64(F.lit(1), run).cast("decimal(20,0)").alias("b"),
        )
        summed = hashed.groupBy("date").agg(
            F.sum("n").alias("byte_size"), F.count(F.lit(1)).alias("runs"), F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        parts = [F.col(c).cast("string") for c in ("byte_size", "runs", "a", "b")]
        return summed.select("date", "byte_size", F.sha2(F.concat_ws(":", *parts), 256).alias("files_digest"))

    # -- reading ---------------------------------------------------------------------------

    def describe(self, dataset: str):
        table = self._table("datasets")
        return None if table is None else table.where(F.col("dataset") == dataset).first()

    def _stored(self, dataset: str) -> DataFrame:
        return self.spark.read.schema(f"{BAR_SCHEMA}, date DATE").parquet(self._path("bars", dataset))

    def scan(
        self,
        dataset: str,
        *,
        as_of,
        instruments: Sequence[str] | None = None,
        bar_size: str | None = None,
        start=None,
        end=None,
        columns: Sequence[str] | None = None,
        revisions: str = "as_known",
    ) -> DataFrame:
        """Bars usable at ``as_of``: pruned by day, then filtered in the scan."""
        dates = self.selected_dates(
            dataset, as_of=as_of, instruments=instruments, start=start, end=end
        )
        stored = self._stored(dataset).where(F.col("date").isin(dates))
        return point_in_time(
            stored.select(*BAR_COLUMNS),
            as_of=as_of, instruments=instruments, bar_size=bar_size, start=start, end=end,
            columns=columns, revisions=revisions,
        )

    def selected_dates(self, dataset: str, *, as_of, instruments=None, start=None, end=None) -> list:
        """Days that may hold a matching row, from the metadata tables.

        At most one value per calendar day reaches the driver.
        """
        parts = self.spark.read.parquet(self._path("dataset_partitions", dataset))
        parts = parts.where(F.col("min_available_at") <= instant(as_of))
        if start is not None:
            parts = parts.where(F.col("max_bar_start") >= instant(start))
        if end is not None:
            parts = parts.where(F.col("min_bar_start") < instant(end))
        if instruments is not None:
            held = self.spark.read.parquet(self._path("dataset_instruments", dataset))
            held = held.where(F.col("instrument_id").isin(list(instruments)))
            parts = parts.join(held.select("date"), "date", "left_semi")
        return [r["date"] for r in parts.select("date").orderBy("date").collect()]

    def scan_unfiltered(self, dataset: str, *, reason: str) -> DataFrame:
        """Every row, for work that states why it may ignore availability."""
        if len(reason.strip()) < 8:
            raise ValueError("an unfiltered scan needs a reason of at least eight characters")
        log.info("unfiltered scan of %s: %s", dataset, reason)
        self.spark.sparkContext.setJobDescription(f"unfiltered scan of {dataset}: {reason}")
        return self._stored(dataset).select(*BAR_COLUMNS)

    def verify(self, dataset: str) -> DataFrame:
        """Differences between stored data and its metadata; empty when intact."""
        stored = self._stored(dataset)
        recorded = self.spark.read.parquet(self._path("dataset_partitions", dataset))
        now = partition_stats(stored)
        if "files_digest" in recorded.columns:
            now = now.join(self.file_hashes(dataset), "date", "left")
        names = [c for c in recorded.columns if c != "date" and c in now.columns]
        joined = recorded.select("date", F.struct(*names).alias("recorded")).join(
            now.select("date", F.struct(*names).alias("found")), "date", "full"
        )
        moved = joined.where(~F.col("recorded").eqNullSafe(F.col("found"))).select(
            F.col("date").cast("string").alias("part"),
            F.to_json("recorded").alias("recorded"),
            F.to_json("found").alias("found"),
        )
        known = self.describe(dataset)["content_digest"]
        actual = digest_text(stored.select(*BAR_COLUMNS), BAR_CONTENT)
        whole = self.spark.createDataFrame(
            [("content", known, actual)], "part STRING, recorded STRING, found STRING"
        ).where("recorded != found")
        return moved.unionByName(whole)

    # -- SQL -------------------------------------------------------------------------------

    def tables(self) -> dict[str, DataFrame]:
        """Metadata tables by name, for listing and SQL discovery."""
        names = ("datasets", "dataset_partitions", "dataset_instruments")
        found = {n: self._table(n) for n in names}
        return {n: df for n, df in found.items() if df is not None}

    def register(self, datasets: Sequence[str]) -> list[str]:
        """Views ``datasets``, ``dataset_partitions``, ``bars_<id>``, and ``bars_asof_<id>(t)``.

        Which datasets there are is read from the view ``datasets``; only those asked for get
        views of their own.
        """
        made = []
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)
            made.append(name)
        return made + [self._register(dataset) for dataset in datasets]

    def _register(self, dataset: str) -> str:
        view = f"bars_{dataset}"
        self._stored(dataset).select(*BAR_COLUMNS).createOrReplaceTempView(view)
        register_asof(self.spark, view, f"bars_asof_{dataset}")
        return view

    def query_asof(self, dataset: str, as_of, *, where: str | None = None) -> DataFrame:
        """The as-of table function with an optional extra SQL predicate."""
        self._register(dataset)
        moment = utc(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")
        rows = self.spark.sql(f"SELECT * FROM bars_asof_{dataset}(TIMESTAMP '{moment}')")
        return rows if where is None else rows.where(F.expr(where))


def register_asof(spark: SparkSession, view: str, function: str) -> None:
    """A SQL table function that reads ``view`` as of an instant."""
    columns = ", ".join(BAR_COLUMNS)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(as_of TIMESTAMP) "
        f"RETURNS TABLE({BAR_SCHEMA}) "
        f"RETURN SELECT {columns} FROM {view} WHERE available_at <= {function}.as_of"
    )


def point_in_time(
    bars: DataFrame,
    *,
    as_of,
    instruments: Sequence[str] | None = None,
    bar_size: str | None = None,
    start=None,
    end=None,
    columns: Sequence[str] | None = None,
    revisions: str = "as_known",
) -> DataFrame:
    """Rows available at ``as_of`` (equality included) that start inside ``[start, end)``.

    ``as_known`` takes the highest revision visible at the cutoff; ``all`` keeps every
    visible revision. Column choice comes last, so filters need not be among them.
    """
    if revisions not in ("as_known", "all"):
        raise ValueError("revisions must be as_known or all")
    if start is not None and end is not None and not hasattr(start, "isNull") and utc(start) >= utc(end):
        raise ValueError("start must precede end")
    if instruments is not None and len(set(instruments)) != len(instruments):
        raise ValueError("instrument ids repeat")
    rows = bars.where(F.col("available_at") <= instant(as_of))
    if start is not None:
        rows = rows.where(F.col("bar_start") >= instant(start))
    if end is not None:
        rows = rows.where(F.col("bar_start") < instant(end))
    if instruments is not None:
        rows = rows.where(F.col("instrument_id").isin(list(instruments)))
    if bar_size is not None:
        rows = rows.where(F.col("bar_size") == bar_size)
    if revisions == "as_known":
        rows = latest_revisions(rows)
    return rows if columns is None else rows.select(*columns)


def head(rows: DataFrame, n: int) -> DataFrame:
    """First rows in canonical order; Spark runs this as a top-n without a full sort."""
    return rows.orderBy("instrument_id", "bar_start", "revision").limit(n)


__all__ = ["BarCatalog", "dataset_id", "digest", "head", "partition_stats", "point_in_time"]
