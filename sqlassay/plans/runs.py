"""Benchmark summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import summary
from sqlassay.plans.fixtures import derived, oracle

LABELS = ["contradiction", "neutral", "entailment"]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "runs")


def _trips(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "trips")


def a1(spark: SparkSession, d: str) -> DataFrame:
    return summary.outcome(_runs(spark, d)).select("case_id", "outcome", "skip_message")


def a2(spark: SparkSession, d: str) -> DataFrame:
    return summary.run_counts(_runs(spark, d))


def a3(spark: SparkSession, d: str) -> DataFrame:
    return summary.run_rates(summary.run_counts(_runs(spark, d)))


def a4(spark: SparkSession, d: str) -> DataFrame:
    return summary.avg_latency(_runs(spark, d)).withColumn("avg_latency_s", F.round("avg_latency_s", 6))


def a5(spark: SparkSession, d: str) -> DataFrame:
    history = summary.history_summary(_runs(spark, d), "model")
    return history.withColumn("avg_latency_s", F.round("avg_latency_s", 6))


def a6(spark: SparkSession, d: str) -> DataFrame:
    return summary.running_accuracy(_runs(spark, d))


def a7(spark: SparkSession, d: str) -> DataFrame:
    stats = summary.score_stats(_trips(spark, d), ["model"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean_score", "median_score", "std_score")})


def a8(spark: SparkSession, d: str) -> DataFrame:
    return summary.label_counts(_trips(spark, d))


def a9(spark: SparkSession, d: str) -> DataFrame:
    return summary.error_counts(_trips(spark, d), LABELS, ["model"])


def a12(spark: SparkSession, d: str) -> DataFrame:
    counted = summary.token_counts(derived(spark, d, "pairs"), "reference", "output")
    return counted.select("pair_id", "input_tokens", "output_tokens")


def a13(spark: SparkSession, d: str) -> DataFrame:
    return summary.run_timing(_trips(spark, d), "model", "started_at", "started_at", ["tts_time_sec", "stt_time_sec"])


QUERIES = {
    "A1_outcome": a1, "A2_run_counts": a2, "A3_run_rates": a3, "A4_latency_positive": a4, "A5_history_summary": a5,
    "A6_running_accuracy": a6, "A7_score_stats": a7, "A8_label_counts": a8, "A9_error_counts": a9,
    "A12_token_counts": a12, "A13_run_timing": a13,
}

_COUNTS = """SELECT model, count(*) AS processed, count(*) FILTER (correct = 1) AS correct,
  count(*) FILTER (exact_match = 1) AS exact, count(*) FILTER (generation_error_msg <> '') AS generation_errors,
  count(*) FILTER (error_db_exec = 1) AS execution_errors FROM {runs} r GROUP BY model"""

ORACLES = {
    "A1_outcome": """SELECT case_id, outcome,
        CASE WHEN outcome = 'generation_error' THEN 'Skipped due to generation error' ELSE '' END AS skip_message FROM (
        SELECT case_id, CASE WHEN generation_error_msg LIKE 'PROMPT GENERATION FAILED%' THEN 'prompt_failure'
          WHEN generation_error_msg <> '' THEN 'generation_error' WHEN error_db_exec = 1 THEN 'execution_error'
          WHEN exact_match = 1 THEN 'exact' WHEN correct = 1 THEN 'subset' ELSE 'wrong' END AS outcome FROM {runs} r) o""",
    "A2_run_counts": _COUNTS,
    "A3_run_rates": f"""SELECT *, correct / processed * 100 AS accuracy, exact / processed * 100 AS exact_rate,
        generation_errors / processed * 100 AS generation_error_rate,
        execution_errors / processed * 100 AS execution_error_rate FROM ({_COUNTS}) c""",
    "A4_latency_positive": """SELECT model, round(coalesce(avg(latency_seconds) FILTER (latency_seconds > 0), 0), 6)
        AS avg_latency_s FROM {runs} r GROUP BY model""",
    "A5_history_summary": f"""SELECT c.*, avg_latency_s FROM ({_COUNTS}) c
        JOIN (SELECT model, round(avg(latency_seconds), 6) AS avg_latency_s FROM {{runs}} r GROUP BY model) l USING (model)""",
    "A6_running_accuracy": """SELECT model, case_id, done, correct_so_far, generation_errors_so_far,
          execution_errors_so_far, correct_so_far / done * 100 AS accuracy FROM (
        SELECT model, case_id, count(*) OVER w AS done, CAST(sum(correct) OVER w AS BIGINT) AS correct_so_far,
          CAST(sum(CASE WHEN generation_error_msg <> '' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS generation_errors_so_far,
          CAST(sum(error_db_exec) OVER w AS BIGINT) AS execution_errors_so_far FROM {runs} r
        WINDOW w AS (PARTITION BY model ORDER BY finished_at, case_id ROWS UNBOUNDED PRECEDING)) s""",
    "A7_score_stats": """SELECT model, count(score) AS n, round(avg(score), 6) AS mean_score,
        round(median(score), 6) AS median_score, min(score) AS min_score, max(score) AS max_score,
        round(stddev_samp(score), 6) AS std_score FROM {trips} t WHERE score IS NOT NULL GROUP BY model""",
    "A8_label_counts": "SELECT label, count(*) AS n FROM {trips} t GROUP BY label",
    "A9_error_counts": """SELECT model, count(*) FILTER (coalesce(predicted_sql LIKE '%ERROR%', false)) AS sql_errors,
        count(*) FILTER (NOT coalesce(predicted_sql LIKE '%ERROR%', false) AND regenerated LIKE '%ERROR%') AS text_errors,
        count(*) FILTER (score_error IS NOT NULL) AS score_errors,
        count(*) FILTER (label NOT IN ('contradiction', 'neutral', 'entailment') AND label NOT LIKE '%NO_BEST_Q%') AS label_errors
        FROM {trips} t GROUP BY model""",
    "A12_token_counts": r"""SELECT pair_id,
        CAST(len(list_filter(string_split_regex(reference, '\s+'), lambda t: t <> '')) AS INT) AS input_tokens,
        CAST(len(list_filter(string_split_regex(output, '\s+'), lambda t: t <> '')) AS INT) AS output_tokens FROM {pairs} p""",
    "A13_run_timing": """SELECT model, count(*) AS items,
        round((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1000000, 3) AS wall_seconds,
        round(sum(tts_time_sec), 3) AS tts_time_sec_total, round(avg(tts_time_sec), 3) AS tts_time_sec_mean,
        round(sum(stt_time_sec), 3) AS stt_time_sec_total, round(avg(stt_time_sec), 3) AS stt_time_sec_mean
        FROM {trips} t GROUP BY model""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
