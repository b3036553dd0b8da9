"""Source to dataset: normalise, check, refuse or write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from pitbars.operators.normalize import apply_duplicate_policy
from pitbars.operators.quality import refuse_on_error, validate
from pitbars.operators.resample import latest_revisions, resample
from pitbars.session import staged
from pitbars.sources.catalog import BarCatalog


def ingest(
    catalog: BarCatalog,
    bars: DataFrame,
    identity: Mapping,
    *,
    bar_size: str,
    latency,
    duplicates: str = "error",
    expect_grid: bool = False,
    missing_severity: str = "warning",
    sessions: DataFrame | None = None,
    tz: str = "UTC",
    unmapped: DataFrame | None = None,
) -> tuple[str, bool, DataFrame]:
    """Dataset id, whether it existed, and its findings. Any error finding refuses the write.

    The normalised bars are stored once; checks, digest and write read that copy, each only the
    columns it needs.
    """
    if duplicates == "error":  # looks for repeats at once, so it reads the settled copy
        settled = apply_duplicate_policy(staged(bars, "settled"), duplicates)
    else:
        settled = staged(apply_duplicate_policy(bars, duplicates), "settled")
    findings = staged(
        validate(
            settled, bar_size=bar_size, latency=latency, expect_grid=expect_grid,
            missing_severity=missing_severity, sessions=sessions, tz=tz, unmapped=unmapped,
        ),
        "findings",
    )
    refuse_on_error(findings)
    dataset, existed = catalog.write(settled, {**identity, "bar_size": bar_size})
    return dataset, existed, findings


def derive(
    catalog: BarCatalog, parent: str, *, source_size: str, target_size: str
) -> tuple[str, bool]:
    """A coarser dataset that names its parent in its identity."""
    bars = catalog.scan_unfiltered(parent, reason=f"derive {target_size} bars from {parent}")
    coarse = resample(latest_revisions(bars), source_size=source_size, target_size=target_size)
    identity = {"parent": parent, "resample": target_size, "bar_size": target_size}
    return catalog.write(staged(coarse, "derived"), identity)
