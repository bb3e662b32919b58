from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sqlassay.session import fresh_path
from sqlassay.sources import cases as cs
from sqlassay.sources import results as rs
from sqlassay.sources import tables as tb


def write_text(spark, name, text):
    path = fresh_path(spark, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_tables_are_named_after_their_files(spark):
    good = write_text(spark, "my data.csv", "a b,c-d\n1,x\n2,y\n")
    found = tb.load_tables(spark, [good, "/nowhere/absent.csv"])
    assert list(found) == ["my_data"] and found["my_data"].columns == ["a_b", "c_d"]
    assert spark.sql("SELECT sum(a_b) AS s FROM my_data").first()["s"] == 3


def test_name_clashes_are_errors(spark):
    one, two = write_text(spark, "a-b.csv", "x\n1\n"), write_text(spark, "a_b.csv", "x\n1\n")
    with pytest.raises(ValueError, match="already taken"):
        tb.load_tables(spark, [one, two])
    with pytest.raises(ValueError, match="same name"):
        tb.load_tables(spark, [write_text(spark, "t.csv", "x y,x-y\n1,2\n")])


def test_late_values_still_count_for_the_type(spark):
    path = write_text(spark, "late.csv", "v\n" + "1\n" * 50 + "1.5\n")
    catalog = tb.infer_catalog(tb.load_tables(spark, [path]))
    assert [tuple(r) for r in catalog.collect()] == [("late", 0, "v", "REAL")]


CASES = '''question,query,data_csv_files,query_category
"How many, in
total?",SELECT count(*) FROM customers;,customers.csv,simple
Second,SELECT 1,"a.csv, b.csv,",
Broken,SELECT 2,a.csv,b.csv,Join
'''


def test_cases(spark):
    path = write_text(spark, "cases.csv", CASES)
    rows = {r["question"]: r for r in cs.load_cases(spark, path).collect()}
    assert rows["How many, in\ntotal?"]["query_category"] == "simple"
    assert rows["Second"]["query_category"] == "" and rows["Second"]["glossary"] == ""
    assert rows["Broken"]["_corrupt_record"] and rows["Second"]["_corrupt_record"] is None
    assert [r["question"] for r in cs.load_cases(spark, path, n=1).collect()] == ["How many, in\ntotal?"]


def test_cases_need_their_columns(spark):
    with pytest.raises(ValueError, match="data_csv_files"):
        cs.load_cases(spark, write_text(spark, "cases.csv", "question,query\na,b\n"))


def test_results_layout_and_history(spark):
    path = fresh_path(spark, "history")
    rows = spark.createDataFrame([("q, 1", 0.12345, "z", "a", 1)], "question string, latency_seconds double, zeta string, alpha string, correct int")
    assert rs.result_layout(rows).columns == ["question", "latency_seconds", "correct", "alpha", "zeta"]
    rs.write_results(rows, path)
    rs.write_results(rows.withColumn("question", F.lit("later")), path)
    schema = "question string, latency_seconds double, correct int, alpha string, zeta string"
    found = rs.run_history(spark, path, schema).collect()
    assert {r["question"] for r in found} == {"q, 1", "later"} and found[0]["latency_seconds"] == 0.123
    assert found[0]["written_at"] >= found[1]["written_at"]


def test_metric_without_rows_is_null(spark):
    scores = spark.createDataFrame([(1, "A-b (C)", 1.0, "r")], "test_id bigint, name string, score double, reason string")
    found = rs.metrics_wide(scores, "test_id", ["A-b (C)", "Other"]).first()
    assert found["a_b_c_score"] == 1.0 and found["other_score"] is None
