"""Bar files: CSV, gzipped CSV and Parquet, one or many, with a column mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitbars.operators.normalize import bar_bounds, resolve_symbols, with_availability
from pitbars.types import BAR_COLUMNS

OFFSET = r"(Z|z|[+-]\d\d:?\d\d)$"
# The names of the input columns. The first must be there, the others may.
NEEDED = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
OPTIONAL = ("vwap", "trade_count", "source_key", "revision", "available_at")
_SUFFIXES = {".csv": "csv", ".csv.gz": "csv", ".parquet": "parquet"}


@dataclass(frozen=True)
class Source:
    """A file or folder, its format unless the name tells it, and the revision of its rows."""

    path: str
    file_format: str | None = None
    revision: int = 0

    @property
    def kind(self) -> str:
        known = self.file_format or next((f for s, f in _SUFFIXES.items() if self.path.endswith(s)), None)
        if known not in ("csv", "parquet"):
            raise ValueError(f"unsupported source {self.path!r}; state csv or parquet, or use {sorted(_SUFFIXES)}")
        return known


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """Raw rows of a file or of all files below a folder; CSV stays text, so no type is guessed."""
    if source.kind == "parquet":
        reader = spark.read.format("parquet")
    else:
        reader = spark.read.format("csv").option("header", True).option("mode", "FAILFAST")
    return reader.option("recursiveFileLookup", True).load(source.path)


def strict_utc(df: DataFrame, column: str, *, assume_utc: bool = False) -> Column:
    """A UTC timestamp from a column that states its offset.

    A zone-less column is refused unless ``assume_utc``. Text is checked on every row; a
    value without an offset fails the query when it is read.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.TimestampNTZType):
        if not assume_utc:
            raise ValueError(f"column {column!r} has no time zone; state assume_utc=True")
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        refuse = F.raise_error(F.concat(F.lit(f"{column} has no UTC offset: "), c))
        return F.when(c.isNull() | c.rlike(OFFSET), F.to_timestamp(c)).otherwise(refuse)
    raise ValueError(f"column {column!r} is {kind.simpleString()}; expected a timestamp or text")


def source_columns(df: DataFrame, mapping: Mapping[str, str]) -> dict[str, str]:
    """The source column of each canonical one; every problem of the mapping is reported at once.

    A needed column not in the mapping goes by its canonical name; an optional one is absent.
    """
    found = {name: mapping.get(name, name) for name in NEEDED} | {n: mapping[n] for n in OPTIONAL if n in mapping}
    unknown = sorted(set(mapping) - set(found))
    lacking = sorted(f"{name} ({column})" for name, column in found.items() if column not in df.columns)
    problems = [f"it lacks {lacking}"] if lacking else []
    problems += [f"the mapping names {unknown}, which are no canonical columns"] if unknown else []
    if problems:
        raise ValueError(f"source with columns {sorted(df.columns)}: {'; '.join(problems)}")
    return found


def _canonical(raw: DataFrame, mapping: Mapping[str, str], source: Source, assume_utc: bool, keep_file: bool) -> DataFrame:
    """The rows of one source under canonical names and types."""
    names = source_columns(raw, mapping)

    def maybe(name: str, kind: str, default: Column) -> Column:
        return (F.col(names[name]) if name in names else default).cast(kind).alias(name)

    nothing = F.lit(None)
    ready = strict_utc(raw, names["available_at"], assume_utc=assume_utc) if "available_at" in names else nothing
    return raw.select(
        F.col(names["symbol"]).cast("string").alias("symbol"),
        strict_utc(raw, names["timestamp"], assume_utc=assume_utc).alias("source_ts"),
        *[F.col(names[c]).cast("double").alias(c) for c in NEEDED[2:]],
        maybe("vwap", "double", nothing),
        maybe("trade_count", "bigint", nothing),
        maybe("source_key", "string", F.col("_metadata.file_name") if keep_file else nothing),
        maybe("revision", "int", F.lit(source.revision)),
        ready.cast("timestamp").alias("provider_at"),
    )


def read_bars(
    spark: SparkSession,
    sources: str | Source | Sequence[str | Source],
    *,
    aliases: DataFrame,
    bar_size: str,
    label: str,
    latency,
    source: str,
    ingested_at: Column | None = None,
    mapping: Mapping[str, str] | None = None,
    assume_utc: bool = False,
    keep_file: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Canonical bars of one or many sources and the symbols that had no instrument.

    ``sources`` are paths of files or folders, alone or as a list; formats may be mixed. Rows
    without a mapped ``revision`` take that of their source. ``keep_file`` puts the file's
    name into ``source_key`` where no column gives one. ``mapping`` says which source column
    holds a canonical one.
    """
    listed = [sources] if isinstance(sources, str | Source) else list(sources)
    if not listed:
        raise ValueError("no sources")
    listed = [s if isinstance(s, Source) else Source(s) for s in listed]
    known = dict(mapping or {})
    timed_at_source = "available_at" in known
    picked = reduce(
        DataFrame.unionByName,
        [_canonical(read_source(spark, s), known, s, assume_utc, keep_file) for s in listed],
    )
    bounded = bar_bounds(picked, at="source_ts", label=label, bar_size=bar_size)
    timed = with_availability(
        bounded, latency=latency, source="provider_at" if timed_at_source else None
    )
    resolved, unmapped = resolve_symbols(timed, aliases, symbol="symbol", at="bar_start")
    stamped = resolved.withColumns(
        {
            "bar_size": F.lit(bar_size),
            "source": F.lit(source),
            "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
        }
    )
    return stamped.select(*BAR_COLUMNS), unmapped
