"""Result files: write with a fixed layout, read past runs, metric rows to wide rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlassay.functions.cells import half_even

RESULT_COLUMNS = [
    "question", "query", "data_csv_files", "query_category", "instructions", "glossary", "k_shot_prompt",
    "schema_string", "table_aliases_str", "prompt_generated", "generated_query", "latency_seconds", "input_tokens",
    "output_tokens", "generation_error_msg", "exact_match", "correct", "exec_error_msg", "error_db_exec",
]


def result_layout(results: DataFrame) -> DataFrame:
    """Known columns in their order, extras alphabetically, fractions with three decimals."""
    known = [c for c in RESULT_COLUMNS if c in results.columns]
    extras = sorted(c for c in results.columns if c not in RESULT_COLUMNS)
    types = {f.name: f.dataType for f in results.schema}

    def shown(name: str):
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            return F.format_string("%.3f", half_even(F.col(name).cast("double"), 3)).alias(name)
        return F.col(name)

    return results.select(*[F.when(F.col(n).isNotNull(), shown(n)).alias(n) for n in known + extras])


def write_results(results: DataFrame, path: str, run: str | None = None, form: str = "csv") -> None:
    """Write in the fixed layout, one folder per run where ``run`` names the run column."""
    writer = result_layout(results).write.mode("append")
    if run:
        writer = writer.partitionBy(run)
    if form == "csv":
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.format(form).save(path)


def run_history(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Stored results with file name and time, newest file first."""
    stored = spark.read.schema(schema).csv(path, header=True, escape='"')
    named = stored.select(
        "*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("written_at")
    )
    # Ranges of (file, digest of the row): a large file is several tasks, and files follow one another.
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in stored.columns])
    order = [F.desc("written_at"), F.asc("file_name")]
    return named.repartitionByRange(*order, spread).sortWithinPartitions(*order)


def metric_slug(name: str) -> str:
    """Column prefix of a metric: its letters and digits in lower case, each run of anything else one ``_``."""
    slug = re.sub(r"[\W_]+", "_", name.lower()).strip("_")
    if not slug:
        raise ValueError(f"a metric needs a letter or digit in its name: {name!r}")
    return slug


def metrics_wide(scores: DataFrame, test: str, metrics: Sequence[str]) -> DataFrame:
    """One row per test with ``<metric>_score`` and ``<metric>_reason``; a metric without rows is null."""
    slugs = [metric_slug(name) for name in metrics]
    if len(set(slugs)) < len(slugs):
        raise ValueError(f"metrics share a column prefix: {sorted(s for s in set(slugs) if slugs.count(s) > 1)}")
    parts = []
    for name in metrics:
        for part in ("score", "reason"):
            value = F.when(F.col("name") == name, F.col(part))
            parts.append(F.first(value, ignorenulls=True).alias(f"{metric_slug(name)}_{part}"))
    return scores.groupBy(test).agg(*parts)
