"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import re

import pytest
from oracle_check import connect, difference

import __spark_entry__ as registered
from pairloom.workload.oracles import ORACLES
from pairloom.workload.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def duck(data_dir):
    with connect(data_dir) as con:
        yield con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, data_dir, duck, name):
    df = QUERIES[name](spark, data_dir)
    assert difference(df, duck, ORACLES[name]) is None
    # Native expressions and keyed joins only; saved dataset folders are scanned by a Python data source.
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"BatchScan pairloom_saved\[[^\]]*\] \(Python\)", "BatchScan", plan)
    assert not re.search("Python|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_entry(spark):
    assert {r["split"] for r in registered.entry(spark).collect()} >= {"test"}
