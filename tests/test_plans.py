"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from framescope.plans.catalog import Tables

FOLDER = "/root/testdata/sf0.001"

# Queries whose result needs more than one pass over a table, with the passes they may take.
PASSES = {
    "composition_with_metric": {"documents": 1},
    "exception_breakdown": {"documents": 1},
    "exception_report": {"documents": 2},
    "group_stats": {"orders": 2},
    "metric_histograms": {"lineitem": 2},
    "metric_means_by_group": {"customer": 1},
    "metric_profile": {"lineitem": 2},
    "quality_rollup": {"documents": 2},
    "stacked_bounds": {"events": 1},
    "text_kpis": {"documents": 1},
    "top_terms": {"documents": 1},
    "top_values_with_others": {"part": 1},
    "trait_lift": {"documents": 1},
    "value_counts": {"documents": 1},
    "volume_by_day": {"events": 1},
    "volume_pivot": {"events": 2},
}


def records_read(spark) -> int:
    """Records that all stages of the session have read from files so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    nothing = context._jvm.java.util.ArrayList()
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(nothing, False, False, quantiles, nothing).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().inputRecords()
    return total


@pytest.mark.parametrize("name", sorted(PASSES))
def test_passes_over_the_table(spark, name):
    (table, passes), = PASSES[name].items()
    tables = Tables(spark, FOLDER)
    rows = getattr(tables, table).count()
    if table == "documents":
        joined = name in ("composition_with_metric", "trait_lift", "value_counts")
        rows += tables.labels.count() if joined else 0
    before = records_read(spark)
    contract.queries()[name](spark, FOLDER).collect()
    assert records_read(spark) - before <= passes * rows


def test_scan_is_pruned(spark):
    plan = contract.queries()["volume_by_day"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<ts:timestamp_ntz,event_type:string>"}
    assert "IsNotNull(ts)" in plan


def test_text_is_cleaned_once_per_row(spark):
    for name in ("keywords", "bigrams", "top_terms"):
        plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if " Filter " in line:
                assert "regexp_extract_all" not in line
