"""From raw documents to sharded training data: five stages over tables in the shared folder.

Each stage is written as Parquet and read again as the next one's documents, so a stage is
computed once and a lost executor costs one re-read. All but the last return the columns they
were given. Decisions are made and applied row by row, by the row's place in the stored input: what
is decided on one row touches no other that happens to share its id, or has none.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.llm import dartminhash, langid, mixing, sharding, winnowing
from pitbars.llm.graph import join_checked
from pitbars.llm.queries import contaminated, taught
from pitbars.llm.rows import numbered
from pitbars.session import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language: without letters, or with a narrow lead (``langid.MARGIN``).

    The model is fitted on the documents of the stage's input that may teach it.
    """
    model = langid.fit(taught(docs), F.col("text"), F.col("lang"), F.col("doc_id"))
    rows = numbered(docs)
    told = langid.predict(rows, F.col("__row"), F.col("text"), model)
    gone = staged(told.where("rejected").select(F.col("id").alias("__row")), "rejected")
    return join_checked(rows, gone, ["__row"], "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each class of near-duplicates."""
    return dartminhash.drop_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover at least a twentieth."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    rows = numbered(docs)
    found = winnowing.contamination(rows.select(F.col("__row").alias("doc_id"), "text"), benchmark)
    gone = staged(found.where(contaminated()).select(F.col("doc_id").alias("__row")), "contaminated")
    return join_checked(rows, gone, ["__row"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents as the mix of sources takes them.

    A document's copies are the words taken divided by its size, rounded to the nearest; the
    mix takes each source in order, so at most one document a source and repeat is rounded.
    Rows without an id cannot be told apart and stay once.
    """
    made = mixing.mix(docs, F.col("doc_id"), F.col("source"), mixing.word_count(F.col("text")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    # Rows that repeat an id share the larger number.
    taken = staged(
        made.docs.where("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.max(copies).cast("int").alias("__copies")),
        "copies",
    )
    joined = join_checked(docs, taken, ["doc_id"], "left")
    times = F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1)))
    repeated = joined.where("__copies is null or __copies > 0").withColumn("__copy", F.explode(times))
    return repeated.select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in one of eight shards of near-equal bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = sharding.assign_shards(docs, F.col("doc_id"), F.md5(text), F.octet_length(text) + 1, shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "shard", "slot")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Compression sizes and dart hashes are not expressible in SQL; tests hold the stages against
#: plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is stored before the next reads it."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
