"""Every registered query against its SQL."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from framescope.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["period", "series", "series_rank", "n"]
    assert frame.count() > 0


BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow")


def check_plan(plan: str) -> None:
    """No cross join, no Python, and no window without a partition but on a limited frame."""
    for name in BANNED:
        assert name not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[.*\], \[[^\]]*\]$", line) and "], [" in line and line.count("], [") == 1:
            assert "TakeOrderedAndProject" in "".join(lines[i : i + 6])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    check_plan(frame._jdf.queryExecution().executedPlan().toString())
    assert compare(frame, connection, ORACLES[name]) is None
