"""Chunked order-dependent helpers against plain loops, with one key holding a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import ordered

SECOND = 1_000_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        at = rng.randrange(0, 5000) * SECOND
        out.append((key, i, at, rng.choice([0, 30, 60, 300]), rng.random() < 0.02, rng.randrange(100)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    schema = "key bigint, id bigint, at bigint, gap bigint, reset boolean, value bigint"
    return spark.createDataFrame(rows, schema).repartition(5)


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("span", [7, 100, 1000, 10**6])
@pytest.mark.parametrize("with_reset", [False, True])
def test_spaced(table, rows, span, with_reset):
    expected = {}
    for group in by_key(rows).values():
        allowed = None
        for _, i, at, gap, reset, _ in group:
            expected[i] = allowed is None or at >= allowed or (with_reset and reset)
            if expected[i]:
                allowed = at + gap * SECOND
    reset = F.col("reset") if with_reset else None
    found = ordered.spaced(table, ["key"], F.col("at"), "id", F.col("gap") * F.lit(SECOND), "ok", reset, span * SECOND)
    assert found.columns == [*table.columns, "ok"]
    assert {r["id"]: r["ok"] for r in found.collect()} == expected


@pytest.mark.parametrize("span", [7, 1000, 10**6])
def test_previous_row(table, rows, span):
    expected = {}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            expected[row[1]] = before[5] if before else None
    chunk = F.floor(F.col("at") / (span * SECOND)).cast("bigint")
    found = ordered.previous_row(table, ["key"], ["at", "id"], chunk, ["value"], "before")
    assert {r["id"]: r["before"] and r["before"]["value"] for r in found.collect()} == expected


@pytest.mark.parametrize("span", [7, 1000, 10**6])
def test_running_sums(table, rows, span):
    expected = {}
    for group in by_key(rows).values():
        total = 0
        for n, row in enumerate(group, 1):
            total += row[5]
            expected[row[1]] = (n, total)
    chunk = F.floor(F.col("at") / (span * SECOND)).cast("bigint")
    sums = {"n": F.lit(1).cast("bigint"), "total": F.col("value")}
    found = ordered.running_sums(table, ["key"], ["at", "id"], chunk, sums)
    assert {r["id"]: (r["n"], r["total"]) for r in found.collect()} == expected


def test_measured_span_bounds_the_busiest_key(table, rows):
    span = ordered.measured_span(table, ["key"], F.col("at"), target=50)
    hottest = max(
        sum(1 for r in group if r[2] // (3600 * SECOND) == hour) for group in by_key(rows).values() for hour in (0, 1)
    )
    assert span == 3600 * SECOND * 50 // hottest


def test_groups_across_arrow_batches(spark, table, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        test_spaced(table, rows, 10**6, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
