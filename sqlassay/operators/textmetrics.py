"""Scores of text pairs: all metrics of a row in one scan, and which metrics a use case gets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.functions import text as tx
from sqlassay.functions.cells import half_even
from sqlassay.functions.rows import exploded, let
from sqlassay.operators.judge import score_row
from sqlassay.sources.tables import small_table

Metric = Callable[[Column, Column], Column]


def equals(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", tx.equals_score(F.col("output"), F.col("reference")))


def contains(pairs: DataFrame, substring: Column, case_sensitive: bool = True) -> DataFrame:
    return pairs.withColumn("score", tx.contains_score(F.col("output"), substring, case_sensitive))


def regex_match(pairs: DataFrame, pattern: str) -> DataFrame:
    return pairs.withColumn("score", tx.regex_score(F.col("output"), pattern))


def is_json(rows: DataFrame, text: str = "output") -> DataFrame:
    return rows.withColumn("score", tx.json_score(F.col(text)))


def levenshtein_ratio(pairs: DataFrame) -> DataFrame:
    output, reference = F.col("output"), F.col("reference")
    measured = pairs.withColumn("distance", tx.levenshtein_distance(output, reference))
    return measured.withColumn("score", tx.score_of_distance(output, reference, F.col("distance")))


def _says(score: Column, yes: str, no: str, rest: str) -> Column:
    return F.concat(F.lit("Output "), F.when(score == 1.0, yes).otherwise(no), F.lit(f" {rest}."))


def equals_metric(output: Column, reference: Column) -> Column:
    score = tx.equals_score(output, reference)
    return score_row("equals", score, _says(score, "matches", "does not match", "the reference"))


def contains_metric(substring: str, case_sensitive: bool = True) -> Metric:
    def metric(output: Column, reference: Column) -> Column:
        score = tx.contains_score(output, F.lit(substring), case_sensitive)
        rest = f"the substring '{substring}' (case sensitive: {case_sensitive})"
        return score_row("contains", score, _says(score, "contains", "does not contain", rest))

    return metric


def regex_metric(pattern: str) -> Metric:
    def metric(output: Column, reference: Column) -> Column:
        score = tx.regex_score(output, pattern)
        return score_row("regex_match", score, _says(score, "matches", "does not match", f"the regex pattern '{pattern}'"))

    return metric


def json_metric(output: Column, reference: Column) -> Column:
    score = tx.json_score(output)
    return score_row("is_json", score, _says(score, "is valid", "is invalid", "JSON"))


def levenshtein_metric(output: Column, reference: Column) -> Column:
    def row(distance: Column) -> Column:
        score = tx.score_of_distance(output, reference, distance)
        reason = F.when(distance < 0, F.lit("Inputs must be strings.")).otherwise(
            F.format_string("Levenshtein distance: %d. Similarity ratio: %.4f.", distance, half_even(score, 4))
        )
        return score_row("levenshtein_ratio", score, reason, F.create_map(F.lit("distance"), distance.cast("string")))

    # The distance is the costly part and is used five times.
    return let(tx.levenshtein_distance(output, reference), row)


METRICS: dict[str, Metric] = {
    "equals": equals_metric,
    "contains": contains_metric("select", case_sensitive=False),
    "is_json": json_metric,
    "levenshtein_ratio": levenshtein_metric,
}


def score_rows(pairs: DataFrame, metrics: Mapping[str, Metric] = METRICS, key: str = "pair_id") -> DataFrame:
    """One score row per (pair, metric): ``name, score, reason, metadata``."""
    rows = F.array(*[m(F.col("output"), F.col("reference")) for m in metrics.values()])
    return exploded(pairs, [key], rows, "row").select(key, "row.*")


# Metrics per use case; the flag says whether one needs a reference.
USE_CASES = [
    ("Text-to-SQL", "equals", True),
    ("Text-to-SQL", "contains", False),
    ("Text-to-SQL", "criteria", False),
    ("Document RAG", "hallucination", False),
    ("Document RAG", "context_precision", False),
    ("Document RAG", "context_recall", False),
    ("Document RAG", "answer_relevance", False),
    ("Document RAG", "usefulness", False),
    ("Document RAG", "levenshtein_ratio", True),
    ("Agentic Steps", "criteria", False),
    ("Simple QA & Moderation", "equals", True),
    ("Simple QA & Moderation", "moderation", False),
    ("Simple QA & Moderation", "answer_relevance", False),
]


def use_case_metrics(spark: SparkSession) -> DataFrame:
    return small_table(spark, USE_CASES, "use_case string, metric string, needs_reference boolean")


def bundle(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per (item, metric of its use case); metrics without their reference are left out.

    The mapping is small, inline and of known size, so the join is a broadcast.
    """
    blank = F.col("reference").isNull() | F.trim("reference").isin("", "N/A")
    return items.join(mapping, "use_case").filter(~(F.col("needs_reference") & blank)).drop("needs_reference")
