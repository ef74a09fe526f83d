"""Every registered query on the smallest data: equal to its SQL text, and no pairing plan."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    msg, _ = compare(spark, SF, name, QUERIES[name], ORACLES.get(name), con)
    assert msg.startswith(("ok", "rows-only")), msg


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_all_pairs_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert {"bag", "frame_id", "tx", "yaw"} <= set(df.columns) and df.count() > 0
