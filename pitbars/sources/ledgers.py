"""Feature tables and run ledgers as stored tables."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.functions.features import FeatureSpec
from pitbars.functions.scalars import floor_time
from pitbars.sources.digests import economic_digest
from pitbars.types import DAY


def write_features(features: DataFrame, specs: Sequence[FeatureSpec], path: str) -> None:
    """Feature rows by day and, next to them, one row per feature that says what it is."""
    day = F.to_date(floor_time("bar_start", DAY))
    (
        features.withColumn("date", day)
        .repartitionByRange("date", "instrument_id", "bar_start")
        .sortWithinPartitions("date", "instrument_id", "bar_start")
        .write.mode("errorifexists").partitionBy("date").parquet(f"{path}/rows")
    )
    rows = [
        (s.name, s.kind, list(s.inputs), s.lookback, s.contiguous, s.latency_us, str(dict(s.params)),
         hashlib.sha256(s.describe().encode()).hexdigest())
        for s in specs
    ]
    schema = (
        "name STRING, kind STRING, inputs ARRAY<STRING>, lookback INT, contiguous BOOLEAN, "
        "latency_us BIGINT, params STRING, fingerprint STRING"
    )
    features.sparkSession.createDataFrame(rows, schema).coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/specs"
    )


class LedgerStore:
    """Ledgers of finished runs: ``<root>/<ledger>/run_id=<id>`` and a ``runs`` row last."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def publish(self, run_id: str, frames: Mapping[str, DataFrame], about: Mapping[str, str]) -> str:
        """Store all ledgers of a run; the run shows up only after its last ledger is in.

        Files of a failed attempt are replaced. A finished run is kept when the digest
        agrees and refused when it does not.
        """
        money = economic_digest(frames["fills"], frames["equity_curve"])
        done = self.describe(run_id)
        if done is not None:
            if done["economic_digest"] != money:
                raise ValueError(f"run {run_id} exists with other results")
            return money
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run_id}")
        row = [({k: str(v) for k, v in about.items()}, sorted(frames), money)]
        self.spark.createDataFrame(
            row, "about MAP<STRING,STRING>, ledgers ARRAY<STRING>, economic_digest STRING"
        ).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/runs/run_id={run_id}")
        return money

    def runs(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/runs")
        except AnalysisException:
            return None

    def describe(self, run_id: str):
        table = self.runs()
        return None if table is None else table.where(F.col("run_id") == run_id).first()

    def load(self, name: str, run_ids: Sequence[str] | None = None) -> DataFrame:
        """One ledger across finished runs."""
        finished = self.runs().select("run_id")
        rows = self.spark.read.parquet(f"{self.root}/{name}").join(finished, "run_id", "left_semi")
        return rows if run_ids is None else rows.where(F.col("run_id").isin(list(run_ids)))

    def by_experiment(self, experiment: str) -> DataFrame:
        return self.runs().where(F.col("about")["experiment_id"] == experiment)

    def reproduces(self, run_id: str, fills: DataFrame, curve: DataFrame) -> bool:
        """Whether recomputed ledgers carry the stored digest."""
        return self.describe(run_id)["economic_digest"] == economic_digest(fills, curve)
