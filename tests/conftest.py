import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from instants import at  # noqa: E402
from pitbars.session import prepare  # noqa: E402
from pitbars.types import BAR_COLUMNS, BAR_SCHEMA  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def make_bars(spark):
    """One-minute bars from closes; ``late`` maps a bar number to extra minutes of delay."""

    def make(closes, *, inst="X", skip=(), late=None, latency=2, volume=100.0, revision=0, opens=None):
        rows = []
        for i, close in enumerate(closes):
            if i in skip:
                continue
            delay = (late or {}).get(i, 0)
            open_ = float(opens[i]) if opens else float(close)
            rows.append(
                (inst, "1m", at(i), at(i + 1), at(i + 1 + delay, latency), open_, float(max(close, open_)) + 1,
                 float(min(close, open_)) - 1, float(close), float(volume), float(close), 10, "test",
                 f"{inst}:{i}", revision, at(i + 1))
            )
        return spark.createDataFrame(rows, BAR_SCHEMA).select(*BAR_COLUMNS)

    return make
