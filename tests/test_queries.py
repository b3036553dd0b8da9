"""Every registered query against its SQL twin, and the shape of the main plans."""

import os

import pytest

from compare import connect, difference
from pitbars.plans.oracles import ORACLES
from pitbars.plans.queries import QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize(
    "name", ["pit_lagged_return", "join_asof", "cross_rank", "resample_1d", "ledger_flat_to_flat_trades"]
)
def test_plans_stay_in_the_jvm_and_partition_finely(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["quality_missing_intervals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1].splitlines()[0] for line in plan.split("FileScan")[1:]]
    assert schemas and all("user_id" not in s and "value" not in s for s in schemas)
