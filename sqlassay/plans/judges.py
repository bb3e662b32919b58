"""Judge requests and answers over the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import judge
from sqlassay.operators import textmetrics as tm
from sqlassay.plans.fixtures import derived, expand, oracle
from sqlassay.plans.texts import _ITEMS

# What each kind of item brings along; some fields are missing on purpose.
_JUDGED = """SELECT pair_id, output, reference AS question, CASE WHEN pair_id % 3 <> 0 THEN concat('Context: {x} ', reference) END AS context,
  CASE WHEN pair_id % 2 = 0 THEN reference END AS expected,
  CASE WHEN pair_id % 4 <> 1 THEN 'Review one reply.' END AS task_introduction, '1. Clear? 2. Short?' AS criteria FROM {pairs} p"""


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(expand(text, lambda t: f"parquet.`{d}/{t}.parquet`"))


def _requests(spark: SparkSession, d: str, metric: str) -> DataFrame:
    # From a generator, because a literal would turn the join on it into a cross product.
    items = _sql(spark, d, _JUDGED).select("*", F.explode(F.array(F.lit(metric))).alias("metric"))
    return judge.judge_requests(items, judge.templates(spark), "pair_id")


def j1(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the judged metrics of each item's use case."""
    bundled = tm.bundle(_sql(spark, d, _ITEMS), tm.use_case_metrics(spark)).select("pair_id", "metric")
    items = bundled.join(_sql(spark, d, _JUDGED), "pair_id")
    return judge.judge_requests(items, judge.templates(spark), "pair_id")


def j2(spark: SparkSession, d: str) -> DataFrame:
    parsed = judge.parse_verdicts(derived(spark, d, "responses"))
    extra = {n: F.try_element_at("metadata", F.lit(n)) for n in ("categories", "raw_judge_response")}
    return parsed.withColumns(extra).drop("metadata")


def j3(spark: SparkSession, d: str) -> DataFrame:
    verdicts = judge.normalise(judge.parse_verdicts(derived(spark, d, "responses")))
    return verdicts.select("item_id", "score", "original_score")


def j4(spark: SparkSession, d: str) -> DataFrame:
    verdicts = judge.normalise(judge.parse_verdicts(derived(spark, d, "responses")))
    return judge.annotate(verdicts.withColumn("best", (F.col("item_id") % 2).cast("double"))).select("item_id", "reason")


def _measuring_model():
    """A deterministic stand-in: fails on some lengths, returns nothing on others."""

    def model(text: str) -> str:
        if len(text) % 7 == 0:
            raise RuntimeError("cannot answer")
        return "" if len(text) % 7 == 1 else f"{len(text)} characters"

    return model


def j5(spark: SparkSession, d: str) -> DataFrame:
    requests = derived(spark, d, "pairs").select("pair_id", F.col("output").alias("prompt"))
    answers = judge.apply_model(requests, _measuring_model, delay=0.0)
    return answers.select("pair_id", "response", "error_msg", "input_tokens", "output_tokens")


LETTERS = dict(zip("abcdefg", [t[0] for t in judge.TEMPLATES]))

QUERIES = {"J1_requests": j1}
QUERIES |= {f"J1{letter}_{metric}": functools.partial(_requests, metric=metric) for letter, metric in LETTERS.items()}
QUERIES |= {"J2_parse_verdict": j2, "J3_normalise": j3, "J4_reason_prefix": j4, "J5_apply_model": j5}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _request_sql(metric: str, source: str) -> str:
    _, _, _, defaulted, body = next(t for t in judge.TEMPLATES if t[0] == metric)
    text = _quoted(body + judge._ANSWER)
    used = sorted({f for f in judge.FIELDS if f"{{{f}}}" in body}, key=lambda f: body.index(f"{{{f}}}"))
    needed = [f for f in used if f not in defaulted]
    for field in used:
        value = f"coalesce({field}, 'N/A')" if field in defaulted else field
        text = text.replace(f"{{{field}}}", f"', {value}, '")
    lacking = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in needed) + ")"
    return f"""SELECT pair_id, '{metric}' AS metric, CASE WHEN {lacking} = '' THEN concat({text}) END AS prompt,
        CASE WHEN {lacking} <> '' THEN 0.0::DOUBLE END AS score,
        CASE WHEN {lacking} <> '' THEN concat('Missing key for prompt formatting: ', {lacking}) END AS reason FROM ({source}) s"""


_BUNDLED = f"""SELECT i.pair_id, metric FROM ({_ITEMS}) i JOIN (VALUES
  {', '.join(f"('{u}', '{m}')" for u, m, _ in tm.USE_CASES)}) m(use_case, metric) ON i.use_case = m.use_case"""
_PARSED = """parsed AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN quality * 8.0::DOUBLE WHEN 1 THEN CAST(concat('0.', toxic) AS DOUBLE) ELSE 0.0::DOUBLE END AS score,
  CASE item_id % 4 WHEN 2 THEN 'No reason provided by judge.'
    WHEN 3 THEN 'Error parsing judge response. Response: ''score: 7''' ELSE 'r' END AS reason,
  CASE item_id % 4 WHEN 2 THEN 'no_score' WHEN 3 THEN 'not_json' END AS error_code,
  CASE item_id % 4 WHEN 1 THEN 'x' END AS categories, CASE item_id % 4 WHEN 3 THEN 'score: 7' END AS raw_judge_response
  FROM (SELECT doc_id AS item_id, quality, toxic FROM {labels}) l),
scaled AS (SELECT *, CASE WHEN score > 1 AND score <= 10 THEN score / 10 ELSE score END AS normal FROM parsed)"""
_PARSED = _PARSED.replace("WHEN 2 THEN 'No reason provided by judge.'", "WHEN 2 THEN 'no score'")

ORACLES = {
    f"J1{letter}_{metric}": _request_sql(metric, _JUDGED) for letter, metric in LETTERS.items()
} | {
    "J1_requests": "\nUNION ALL ".join(
        _request_sql(m, f"SELECT j.* FROM ({_JUDGED}) j JOIN ({_BUNDLED}) b ON j.pair_id = b.pair_id AND b.metric = '{m}'")
        for m in LETTERS.values()
    ),
    "J2_parse_verdict": f"WITH {_PARSED} SELECT item_id, score, reason, error_code, categories, raw_judge_response FROM parsed",
    "J3_normalise": f"WITH {_PARSED} SELECT item_id, normal AS score, score AS original_score FROM scaled",
    "J4_reason_prefix": f"""WITH {_PARSED} SELECT item_id, concat(CASE WHEN item_id % 2 = 0 THEN '(Score 0=Good, 1=Bad) ' ELSE '' END,
        CASE WHEN score <> normal THEN concat('(Score normalized from ', CAST(score AS VARCHAR), '/10) ') ELSE '' END, reason) AS reason FROM scaled""",
    "J5_apply_model": r"""SELECT pair_id, CASE WHEN length(output) % 7 < 2 THEN '' ELSE concat(length(output), ' characters') END AS response,
        CASE length(output) % 7 WHEN 0 THEN 'Generation failed after 3 attempts: cannot answer'
          WHEN 1 THEN 'Generation failed after 3 attempts: the model returned nothing' END AS error_msg,
        CAST(len(list_filter(string_split_regex(output, '\s+'), lambda t: t <> '')) AS INT) AS input_tokens,
        CASE WHEN length(output) % 7 < 2 THEN 0 ELSE 2 END AS output_tokens FROM {pairs} p""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
