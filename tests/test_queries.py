"""Every registered query against its SQL oracle, and what its plan must not hold."""

import pytest

import __spark_entry__ as entry
from flowsieve.plans.oracles import ORACLES
from flowsieve.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    python = ("ArrowEvalPython",) if name == "batch_scores" else ()  # a model of another library
    assert not [node for node in FORBIDDEN if node in plan and node not in python]
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_stream_and_table_raise_the_same_alerts(spark):
    rows = QUERIES["stream_detector"](spark, SF).collect()
    assert rows and all(r["n_stream"] == r["n_batch"] for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
