"""Files in and out: the given tables written to the shared folder and read as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.plans.fixtures import GIVEN, TABLES, derived, expand, oracle, table
from sqlassay.session import fresh_path
from sqlassay.sources import cases as cs
from sqlassay.sources import results as rs
from sqlassay.sources.tables import infer_catalog, load_tables

_CASES = """SELECT event_id AS case_id, concat('Show "', event_type, '", by', chr(10), 'value') AS question,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('SELECT value FROM events WHERE user_id = ', CAST(user_id AS VARCHAR(20))) END AS query,
  CASE event_id % 3 WHEN 0 THEN 'events.csv' WHEN 1 THEN 'events.csv, gone.csv' ELSE ' customer.csv ,, ' END AS data_csv_files,
  event_type AS query_category FROM {events}"""


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(expand(text, lambda t: f"parquet.`{d}/{t}.parquet`"))


def s1(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "customer data.csv")
    names = ["c custkey", "c-name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    table(spark, d, "customer").toDF(*names).write.csv(path, header=True)
    loaded = load_tables(spark, [path, fresh_path(spark, "absent.csv")])
    return loaded["customer_data"]


def s2(spark: SparkSession, d: str) -> DataFrame:
    """All given tables; a vector has no CSV form, so that table's columns come from its own file."""
    paths = {name: fresh_path(spark, f"{name}.csv") for name in TABLES if name != "embeddings"}
    for name, path in paths.items():
        table(spark, d, name).write.csv(path, header=True, escape='"')
    tables = load_tables(spark, list(paths.values()), multi_line=True)
    return infer_catalog({**tables, "embeddings": table(spark, d, "embeddings")})


def s3(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "cases")
    _sql(spark, d, _CASES).write.options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path, header=True, escape='"')
    return cs.load_cases(spark, path).drop("_corrupt_record")


def s4(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "events").select(F.concat("event_type", F.lit(".csv")).alias("file"))
    present = present.unionByName(table(spark, d, "customer").select(F.lit("customer.csv").alias("file")))
    present = present.unionByName(table(spark, d, "events").select(F.lit("events.csv").alias("file")))
    return cs.case_files(_sql(spark, d, _CASES), present)


def s5(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "results")
    runs = derived(spark, d, "runs").drop("finished_at")
    rs.write_results(runs.withColumn("question", F.concat(F.lit("Q, "), F.col("case_id").cast("string"))), path, run="model")
    return spark.read.csv(path, header=True, escape='"').withColumn("model", F.col("model").cast("string"))


_HISTORY = """question string, latency_seconds double, input_tokens int, generation_error_msg string, exact_match int,
  correct int, error_db_exec int, case_id bigint"""


def s6(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "history")
    runs = derived(spark, d, "runs").drop("finished_at", "model").withColumn("question", F.lit("q"))
    rs.write_results(runs, path)
    return rs.run_history(spark, path, _HISTORY).drop("file_name", "written_at", "question")


QUERIES = {
    "S1_load_tables": s1, "S2_infer_catalog": s2, "S3_load_cases": s3, "S4_case_files": s4,
    "S5_write_results": s5, "S6_run_history": s6,
}

ORACLES = {
    "S1_load_tables": "SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "S2_infer_catalog": """SELECT table_name, CAST(ordinal_position - 1 AS INT) AS ordinal, column_name,
        CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' ELSE 'TEXT' END AS type_class
        FROM information_schema.columns WHERE table_name IN (""" + GIVEN + ")",
    "S3_load_cases": f"""SELECT CAST(case_id AS VARCHAR) AS case_id, question, coalesce(query, '') AS query, data_csv_files, query_category,
        '' AS instructions, '' AS glossary, '' AS k_shot_prompt, '' AS prev_invalid_sql, '' AS prev_error_msg FROM ({_CASES}) c""",
    "S4_case_files": f"""WITH parts AS (SELECT case_id, list_filter(list_transform(string_split(data_csv_files, ','), lambda f: trim(f)), lambda f: f <> '') AS files
          FROM ({_CASES}) c), named AS (SELECT case_id, unnest(files) AS file, CAST(generate_subscripts(files, 1) - 1 AS INT) AS file_no FROM parts)
        SELECT case_id, file_no, file, file <> 'gone.csv' AS exists FROM named""",
    "S5_write_results": """SELECT concat('Q, ', case_id) AS question, printf('%.3f', round_even(latency_seconds, 3)) AS latency_seconds,
        CAST(input_tokens AS VARCHAR) AS input_tokens, nullif(generation_error_msg, '') AS generation_error_msg, CAST(exact_match AS VARCHAR) AS exact_match,
        CAST(correct AS VARCHAR) AS correct, CAST(error_db_exec AS VARCHAR) AS error_db_exec, CAST(case_id AS VARCHAR) AS case_id,
        CAST(model AS VARCHAR) AS model FROM {runs} r""",
    "S6_run_history": """SELECT CAST(printf('%.3f', round_even(latency_seconds, 3)) AS DOUBLE) AS latency_seconds, input_tokens,
        nullif(generation_error_msg, '') AS generation_error_msg, exact_match, correct, error_db_exec, case_id FROM {runs} r""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
