"""What the plans must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
WRITING = {"S8_check_stream", "H13_stream_alerts", "H14_late_checks"}
NAMES = sorted(set(entry_module.queries()) - WRITING)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bracket_groups(text):
    """The top-level [...] groups of a line."""
    depth, start, groups = 0, 0, []
    for i, c in enumerate(text):
        if c == "[":
            start = i if depth == 0 else start
            depth += 1
        elif c == "]":
            depth -= 1
            if depth == 0:
                groups.append(text[start : i + 1])
    return groups


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_product_and_no_window_over_everything(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in re.findall(r"Window (\[.*)", plan):
        partition = bracket_groups(line)[1]
        assert not re.search(r" (ASC|DESC) ", partition), "a window needs a partition key"


@pytest.mark.parametrize(
    ("name", "pushed", "columns"),
    [
        ("K3", "EqualTo(o_orderstatus,F)", "o_orderkey:bigint,o_orderstatus:string,o_totalprice:double"),
        ("K8", "GreaterThanOrEqual(o_orderdate", "o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate"),
        ("K10", "GreaterThanOrEqual(l_shipdate", "l_orderkey:bigint,l_linenumber:int,l_shipdate"),
        ("K14", "EqualTo(l_returnflag,R)", "l_quantity:double,l_returnflag:string"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    plan = plan_of(entry_module.queries()[name](spark, FOLDER))
    assert pushed in plan
    assert f"ReadSchema: struct<{columns}" in plan
