"""Several generated questions per case: parse, score against the original, keep the best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions import text as tx

LABELS = ["contradiction", "neutral", "entailment"]

NOT_A_LIST, FALLBACK = "not_a_list", "json_parse_fallback"
SQL_EMPTY, SQL_FAILED, BAD_START = "sql_empty", "sql_failed", "sql_bad_start"
NLI_SHAPE, NO_BEST = "nli_shape", "no_best_question"


def strip_fences(rows: DataFrame, text: str = "response") -> DataFrame:
    return rows.withColumn(text, tx.strip_fences(F.col(text)))


def _parsed(response: Column) -> tuple[Column, Column]:
    """(candidates, error code) of an answer that should be a JSON list."""
    readable = tx.is_json(response)
    items = F.from_json(response, "array<string>")
    is_list = response.rlike(r"^\s*\[")
    none = F.array().cast("array<string>")
    candidates = F.when(~readable, F.array(response)).when(is_list, F.coalesce(items, none)).otherwise(none)
    code = F.when(~readable, F.lit(FALLBACK)).when(~is_list, F.lit(NOT_A_LIST))
    return candidates, code


def with_candidates(rows: DataFrame, response: str = "response") -> DataFrame:
    candidates, code = _parsed(F.col(response))
    return rows.withColumns({"candidates": candidates, "parse_code": code})


def parse_candidates(rows: DataFrame, response: str = "response") -> DataFrame:
    """One row per candidate; an answer that is no list keeps one row with its error code."""
    parsed = with_candidates(rows, response).drop(response)
    return parsed.select("*", F.posexplode_outer("candidates").alias("pos", "candidate")).drop("candidates")


def gate_code(sql: Column) -> Column:
    """Why a row may not go on; null for SQL that is there, error-free and a query."""
    missing = sql.isNull() | (sql == "")
    return (
        F.when(missing, F.lit(SQL_EMPTY))
        .when(sql.contains("ERROR"), F.lit(SQL_FAILED))
        .when(~F.upper(F.trim(sql)).rlike("^(SELECT|WITH)"), F.lit(BAD_START))
    )


def gate(rows: DataFrame, sql: str = "predicted_sql") -> DataFrame:
    return rows.withColumn("gate_code", gate_code(F.col(sql)))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def pair_scores(pairs: DataFrame, make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """Score each (question, candidate).

    Without a scorer the edit-distance ratio is used and all stays in the JVM. A caller's
    model is made once per worker and gets whole Arrow batches.
    """
    if make_scorer is None:
        score = tx.levenshtein_score(F.col("question"), F.col("candidate"))
    else:

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            scorer = make_scorer()
            for questions, candidates in batches:
                yield scorer(questions, candidates)

        score = scored("question", "candidate")
    return pairs.withColumn("score", F.when(F.col("candidate").isNotNull(), score))


def best_candidate(scores: DataFrame, key: str = "item_id") -> DataFrame:
    """Highest score and its candidate, the first one on ties."""
    place = F.struct("score", -F.col("pos"))
    best = scores.groupBy(key).agg(F.max_by("candidate", place).alias("best_candidate"), F.max("score").alias("best_score"))
    # Filtered after the aggregate: below it the filter would compute every score twice.
    return best.filter(F.col("best_score").isNotNull())


def label_columns(logits: Column) -> tuple[Column, Column]:
    fits = F.coalesce(F.size(logits) == len(LABELS), F.lit(False))
    place = F.array_position(logits, F.array_max(logits)).cast("int")
    label = F.when(fits, F.element_at(F.array(*[F.lit(x) for x in LABELS]), place))
    return label, F.when(~fits, F.lit(NLI_SHAPE))


def label(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Label of the highest logit; another width than three is an error."""
    value, code = label_columns(F.col(logits))
    return rows.withColumns({"label": value, "error_code": code})


def entailment(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Third logit as a score, null with an error code for another width."""
    fits = F.coalesce(F.size(logits) == len(LABELS), F.lit(False))
    value = F.when(fits, F.get(F.col(logits), 2).cast("double"))
    return rows.withColumns({"score": value, "error_code": F.when(~fits, F.lit(NLI_SHAPE))})


def roundtrip(tests: DataFrame, logits: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per test: SQL, parsed candidates, best score, label and error codes.

    Candidates of a test stay in its row, so scoring and picking the best need no
    shuffle; only the label logits are joined.
    """
    code = gate_code(F.col("predicted_sql"))
    rows = with_candidates(tests.withColumn("gate_code", code)).withColumn(
        "candidates", F.when(F.col("gate_code").isNull(), F.col("candidates")).otherwise(F.array().cast("array<string>"))
    )
    scored = F.transform(
        "candidates",
        lambda c, i: F.struct(
            tx.levenshtein_score(F.col("question"), c).alias("score"), (-i).alias("place"), c.alias("candidate")
        ),
    )
    rows = rows.withColumn("best", F.array_max(scored))
    value, shape = label_columns(F.col("logits"))
    joined = rows.join(logits.select(key, "logits"), key, "left")
    has_best = F.col("best").isNotNull()
    return joined.select(
        key,
        "predicted_sql",
        F.coalesce("gate_code", "parse_code").alias("candidate_code"),
        F.size("candidates").alias("n_candidates"),
        F.col("best.candidate").alias("best_candidate"),
        F.col("best.score").alias("best_score"),
        F.when(has_best, value).alias("label"),
        F.when(~has_best, F.lit(NO_BEST)).otherwise(shape).alias("label_code"),
        *[F.round(c, 3).alias(c) for c in ("tts_time_sec", "stt_time_sec") if c in tests.columns],
        tx.token_count(F.col("question")).alias("tts_input_tokens"),
        tx.token_count(F.col("predicted_sql")).alias("tts_output_tokens"),
    )


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_best(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Best listed candidate of each vector by cosine.

    ``pairs`` lists the candidates ``(vec_id, pos, candidate_id)``, as a question lists
    its paraphrases; work grows with the list, never with all pairs.
    """
    own = vectors.select(F.col(key), F.col("embedding").alias("own"))
    other = vectors.select(F.col(key).alias("candidate_id"), F.col("embedding").alias("other"))
    scored = pairs.join(own, key).join(other, "candidate_id").withColumn("score", _cosine(F.col("own"), F.col("other")))
    named = scored.withColumn("candidate", F.col("candidate_id")).drop("own", "other")
    return best_candidate(named, key)
