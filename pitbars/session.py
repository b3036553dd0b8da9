"""Session defaults and lineage control."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime SQL settings every operator assumes. Idempotent."""
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "pitbars", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``.

    Only a local-mode session that names none, as in tests, gets a folder of its own, which
    goes when the process ends. A cluster without the setting is refused, because executors
    elsewhere could not read a folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; Spark creates it when it first writes there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, *, eager: bool = False) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise an intermediate table under the shared folder and read it back.

    Ordered scans read their input twice, so a chain of them would recompute its source
    many times over. A stored table ends the chain, survives the loss of executors, and
    lets each later pass read only the columns it needs.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
