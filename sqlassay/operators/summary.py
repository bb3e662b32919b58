"""Run summaries: outcomes, counts, rates, latency, scores, labels and tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlassay.functions.text import token_count
from sqlassay.functions.times import micros
from sqlassay.operators.ordered import measured_span, running_sums
from sqlassay.session import landed

PROMPT_FAILED = "PROMPT GENERATION FAILED"
SKIPPED = "Skipped due to generation error"
#: A median's bin with so many values at most is ranked at once.
FEW = 10_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) != 0


def outcome(results: DataFrame) -> DataFrame:
    """Add ``outcome`` and the message of a case whose evaluation was skipped."""
    generation = _text("generation_error_msg") != ""
    state = (
        F.when(_text("generation_error_msg").startswith(PROMPT_FAILED), "prompt_failure")
        .when(generation, "generation_error")
        .when(_flag("error_db_exec"), "execution_error")
        .when(_flag("exact_match"), "exact")
        .when(_flag("correct"), "subset")
        .otherwise("wrong")
    )
    skipped = F.when(state == "generation_error", F.lit(SKIPPED)).otherwise(F.lit(""))
    return results.withColumns({"outcome": state, "skip_message": skipped})


def run_counts(results: DataFrame, run: str = "model") -> DataFrame:
    return results.groupBy(run).agg(
        F.count("*").alias("processed"),
        F.count_if(_flag("correct")).alias("correct"),
        F.count_if(_flag("exact_match")).alias("exact"),
        F.count_if(_text("generation_error_msg") != "").alias("generation_errors"),
        F.count_if(_flag("error_db_exec")).alias("execution_errors"),
    )


def run_rates(counts: DataFrame) -> DataFrame:
    """Rates in percent; a run without cases gets 0."""
    named = {
        "accuracy": "correct",
        "exact_rate": "exact",
        "generation_error_rate": "generation_errors",
        "execution_error_rate": "execution_errors",
    }
    rates = [
        F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("processed")) * 100, F.lit(0.0)).alias(n)
        for n, c in named.items()
    ]
    return counts.select("*", *rates)


def avg_latency(results: DataFrame, run: str = "model", seconds: str = "latency_seconds") -> DataFrame:
    """Mean over positive values only, 0 if there is none."""
    value = F.col(seconds)
    return results.groupBy(run).agg(F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0)).alias("avg_latency_s"))


def history_summary(history: DataFrame, run: str = "run") -> DataFrame:
    """Summary recomputed from stored results; absent columns give 0, latency averages all rows."""

    def total(name: str, value: Column) -> Column:
        counted = value if name in history.columns else F.lit(0)
        return F.coalesce(F.sum(counted), F.lit(0)).cast("bigint")

    latency = F.avg("latency_seconds") if "latency_seconds" in history.columns else F.lit(0.0)
    return history.groupBy(run).agg(
        F.count("*").alias("processed"),
        total("correct", F.col("correct")).alias("correct"),
        total("exact_match", F.col("exact_match")).alias("exact"),
        total(
            "generation_error_msg", F.when(F.trim(_text("generation_error_msg")) != "", 1).otherwise(0)
        ).alias("generation_errors"),
        total("error_db_exec", F.col("error_db_exec")).alias("execution_errors"),
        F.coalesce(latency, F.lit(0.0)).alias("avg_latency_s"),
    )


def running_accuracy(
    results: DataFrame,
    run: str = "model",
    finished: str = "finished_at",
    case: str = "case_id",
    span: int | None = None,
) -> DataFrame:
    """Accuracy and error counts after each completed case of a run."""
    at = micros(results, finished)
    span = span or measured_span(results, [run], at)
    chunk = F.floor(at / F.lit(span)).cast("bigint")
    sums = {
        "done": F.lit(1).cast("bigint"),
        "correct_so_far": _flag("correct").cast("bigint"),
        "generation_errors_so_far": (_text("generation_error_msg") != "").cast("bigint"),
        "execution_errors_so_far": _flag("error_db_exec").cast("bigint"),
    }
    rows = running_sums(results, [run], [finished, case], chunk, sums)
    return rows.select(run, case, *sums, (F.col("correct_so_far") / F.col("done") * 100).alias("accuracy"))


def exact_median(scores: DataFrame, by: list[str], score: str = "score", bins: int = 1024) -> DataFrame:
    """Median per group without a group's values in one task.

    Each round counts a group's values in ``bins`` equal bins between its bounds. Where the two middle ranks
    fall into two bins, or into one of equal values, the median is known; else the bin's least and greatest value are the next bounds.
    One row per group and at most ``bins`` rows per group and round meet, whatever the values are. NaN is the greatest value.
    """
    value, number = F.col("__value"), ~F.isnan("__value")
    rows = scores.filter(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("__value"))
    keys = {k: f"__key_{k}" for k in by}
    state = rows.groupBy(*by).agg(F.count("*").alias("__all"), F.count_if(number).alias("__numbers"), F.min(F.when(number, value)).alias("__least"), F.max(F.when(number, value)).alias("__most"))
    ranks = {"__below": F.lit(0).cast("bigint"), "__low": F.expr("(__all + 1) div 2"), "__high": F.expr("(__all + 2) div 2")}
    state = state.withColumn("__few", (F.col("__all") <= FEW) & (F.col("__all") == F.col("__numbers")))
    state = landed(state.withColumns(ranks).withColumnsRenamed(keys), "median_bounds")
    found = [_ranked_median(rows, state.filter("__few"), keys)]
    state = state.filter("NOT __few").drop("__few")
    while not state.isEmpty():
        on = reduce(Column.__and__, [rows[k].eqNullSafe(state[keys[k]]) for k in by], F.lit(True))
        # Halved, so that the difference of two doubles cannot be infinite.
        place = (value / 2 - F.col("__least") / 2) / (F.col("__most") / 2 - F.col("__least") / 2) * bins
        at = F.when(~number, bins).when(F.col("__least") == F.col("__most"), 0).otherwise(F.least(F.floor(place), F.lit(bins - 1)))
        inside = rows.join(state, on).filter(value.between(F.col("__least"), F.col("__most")) | ~number).withColumn("__bin", at)
        group = [*keys.values(), "__below", "__low", "__high"]
        counted = inside.groupBy(*group, "__bin").agg(F.count("*").alias("__n"), F.min("__value").alias("__first"), F.max("__value").alias("__last"))
        upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("__upto", F.col("__below") + upto)
        holder = lambda rank: F.min(F.when(F.col("__upto") >= F.col(rank), F.struct("__bin", "__first", "__last", "__n", (F.col("__upto") - F.col("__n")).alias("__before"))))
        middle = landed(counted.groupBy(*group).agg(holder("__low").alias("__a"), holder("__high").alias("__b")), "median_bins")
        few = F.col("__a.__n") <= FEW
        known = (F.col("__a.__bin") != F.col("__b.__bin")) | (F.col("__a.__first") == F.col("__a.__last"))
        found.append(middle.filter(known).select(*[F.col(new).alias(old) for old, new in keys.items()], ((F.col("__a.__last") + F.col("__b.__first")) / 2).alias("median_score")))
        bounds = [F.col("__a.__first").alias("__least"), F.col("__a.__last").alias("__most"), F.col("__a.__before").alias("__below")]
        left = landed(middle.filter(~known).select(*keys.values(), *bounds, "__low", "__high", few.alias("__few")), "median_bounds")
        found.append(_ranked_median(rows, left.filter("__few"), keys))
        state = left.filter("NOT __few").drop("__few")
    return reduce(DataFrame.unionByName, found)


def _ranked_median(rows: DataFrame, state: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Medians of groups with few values between their bounds, by ranking these."""
    on = reduce(Column.__and__, [rows[k].eqNullSafe(state[new]) for k, new in keys.items()], F.lit(True))
    inside = rows.join(state, on).filter(F.col("__value").between(F.col("__least"), F.col("__most")))
    rank = F.col("__below") + F.row_number().over(Window.partitionBy(*keys.values()).orderBy("__value"))
    at = lambda r: F.max(F.when(F.col("__rank") == F.col(r), F.col("__value")))
    both = inside.withColumn("__rank", rank).groupBy(*keys.values()).agg(((at("__low") + at("__high")) / 2).alias("median_score"))
    return both.withColumnsRenamed({new: old for old, new in keys.items()})


def score_stats(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean, median, min, max and sample deviation of the scores that exist."""
    plain = scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.stddev_samp(score).alias("std_score"),
    )
    median = exact_median(scores, by, score).withColumnsRenamed({k: f"__key_{k}" for k in by})
    on = reduce(Column.__and__, [plain[k].eqNullSafe(median[f"__key_{k}"]) for k in by], F.lit(True))
    return plain.join(median, on).drop(*[f"__key_{k}" for k in by])


def label_counts(scores: DataFrame, label: str = "label") -> DataFrame:
    return scores.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def error_counts(scores: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Errors per stage; a later stage counts only where the earlier one succeeded."""
    sql_error = F.coalesce(F.col("predicted_sql").contains("ERROR"), F.lit(False))
    text_error = F.coalesce(F.col("regenerated").contains("ERROR"), F.lit(False))
    no_best = F.coalesce(F.col("label").contains("NO_BEST_Q"), F.lit(False))
    known = F.coalesce(F.col("label").isin(labels), F.lit(False))
    return scores.groupBy(*(by or [])).agg(
        F.count_if(sql_error).alias("sql_errors"),
        F.count_if(~sql_error & text_error).alias("text_errors"),
        F.count_if(F.col("score_error").isNotNull()).alias("score_errors"),
        F.count_if(~known & ~no_best).alias("label_errors"),
    )


def tally(results: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Cases and correct cases per pair of expected and actual outcome."""
    return results.groupBy(expected, actual).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col(expected) == F.col(actual)).alias("correct"),
        F.count_if(F.col(expected) != F.col(actual)).alias("incorrect"),
    )


def validity_summary(wide: DataFrame, score: str, judge: str, width: int = 25) -> DataFrame:
    """Per test: id, use case cut to the report width, valid yes or no, judge score."""
    return wide.select(
        "test_id",
        F.substring("use_case", 1, width).alias("use_case"),
        F.when(F.coalesce(F.col(score), F.lit(0.0)) > 0, "No").otherwise("Yes").alias("valid"),
        F.col(judge).alias("judge_score"),
    )


def token_counts(df: DataFrame, prompt: str, output: str) -> DataFrame:
    return df.withColumns({"input_tokens": token_count(F.col(prompt)), "output_tokens": token_count(F.col(output))})


def run_timing(results: DataFrame, run: str, started: str, ended: str, stages: list[str]) -> DataFrame:
    """Wall seconds of a run and seconds per item of each stage, three decimals."""
    wall = (F.max(micros(results, ended)) - F.min(micros(results, started))) / F.lit(1_000_000)
    parts = []
    for stage in stages:
        parts += [F.round(F.sum(stage), 3).alias(f"{stage}_total"), F.round(F.avg(stage), 3).alias(f"{stage}_mean")]
    return results.groupBy(run).agg(F.count("*").alias("items"), F.round(wall, 3).alias("wall_seconds"), *parts)
