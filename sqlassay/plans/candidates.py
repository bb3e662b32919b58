"""Candidate scoring over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import candidates as cd
from sqlassay.plans.fixtures import derived, expand, oracle, table

_FENCED = """SELECT doc_id AS item_id, CASE doc_id % 5
  WHEN 0 THEN concat('Here it is: ```sql', chr(10), 'SELECT ', lang, chr(10), '``` done')
  WHEN 1 THEN concat('```json', chr(10), '["', source, '"]', chr(10), '```') WHEN 2 THEN concat('```', chr(10), text, chr(10), '```')
  WHEN 3 THEN concat('```sql SELECT ', lang) ELSE text END AS response FROM {documents}"""
# Three logits from the whole vector: the sums of its thirds; every ninth has two only.
_LOGITS = {
    "spark": """SELECT vec_id AS item_id, transform(sequence(0, CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END), j -> round(aggregate(
        slice(embedding, j * (size(embedding) div 3) + 1, CASE WHEN j = 2 THEN size(embedding) - 2 * (size(embedding) div 3) ELSE size(embedding) div 3 END),
        CAST(0 AS DOUBLE), (total, x) -> total + x), 6)) AS logits FROM {embeddings}""",
    "duck": """SELECT vec_id AS item_id, list_transform(range(0, CASE WHEN vec_id % 9 = 0 THEN 2 ELSE 3 END), lambda j: round(list_sum(
        embedding[j * (len(embedding) // 3) + 1:CASE WHEN j = 2 THEN len(embedding) ELSE (j + 1) * (len(embedding) // 3) END]::DOUBLE[]), 6)) AS logits FROM {embeddings}""",
}
_TESTS = """SELECT item_id, question, response, CASE WHEN item_id % 10 = 9 THEN 'ERROR_TTS' WHEN item_id % 10 = 8 THEN NULL
    WHEN item_id % 10 = 7 THEN 'UPDATE t' ELSE ' select 1 from t' END AS predicted_sql,
  item_id / 7 AS tts_time_sec, item_id / 3 AS stt_time_sec FROM {candidate_lists} c"""
_NEAR = "SELECT vec_id, pos, vec_id + pos + 1 AS candidate_id FROM {embeddings} JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) p ON 1 = 1"


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(expand(text, lambda t: f"parquet.`{d}/{t}.parquet`"))


def c1(spark: SparkSession, d: str) -> DataFrame:
    return cd.strip_fences(_sql(spark, d, _FENCED))


def c2(spark: SparkSession, d: str) -> DataFrame:
    return cd.parse_candidates(derived(spark, d, "candidate_lists")).select("item_id", "pos", "candidate", "parse_code")


def c3(spark: SparkSession, d: str) -> DataFrame:
    return cd.gate(derived(spark, d, "trips")).select("test_case_id", "gate_code")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return cd.pair_scores(cd.parse_candidates(derived(spark, d, "candidate_lists")))


def c4(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("candidate is not null").select("item_id", "pos", "score")


def c5(spark: SparkSession, d: str) -> DataFrame:
    return cd.best_candidate(_scored(spark, d))


def c6(spark: SparkSession, d: str) -> DataFrame:
    return cd.label(_sql(spark, d, _LOGITS["spark"])).select("item_id", "label", "error_code")


def c7(spark: SparkSession, d: str) -> DataFrame:
    return cd.entailment(_sql(spark, d, _LOGITS["spark"])).select("item_id", "score", "error_code")


def c8(spark: SparkSession, d: str) -> DataFrame:
    return cd.roundtrip(_sql(spark, d, _TESTS), _sql(spark, d, _LOGITS["spark"]))


def c9(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    listed = vectors.select("vec_id", F.posexplode(F.array(*[F.col("vec_id") + i for i in (1, 2, 3)])).alias("pos", "candidate_id"))
    best = cd.vector_best(listed, vectors)
    return best.withColumn("best_score", F.round("best_score", 6))


QUERIES = {
    "C1_strip_fences": c1, "C2_parse_candidates": c2, "C3_gate": c3, "C4_pair_scores": c4, "C5_best_candidate": c5,
    "C6_label": c6, "C7_entailment_score": c7, "C8_result_row": c8, "C9_vector_best": c9,
}

_CANDIDATES = """candidates AS (
  SELECT item_id, question, unnest(CASE item_id % 4 WHEN 0 THEN ['show the first rows', 'list rows', 'what are the rows']
      WHEN 1 THEN [NULL] WHEN 2 THEN [response] ELSE [replace(replace(response, '["', ''), '"]', '')] END) AS candidate,
    unnest(CASE item_id % 4 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [NULL] ELSE [0] END) AS pos,
    CASE item_id % 4 WHEN 1 THEN 'not_a_list' WHEN 2 THEN 'json_parse_fallback' END AS parse_code FROM {candidate_lists} c)"""
_BYTES = "translate({0}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26))"
_SCORES = f"""{_CANDIDATES}, scores AS (SELECT item_id, candidate, pos,
  (greatest(length(question), length(candidate)) - levenshtein({_BYTES.format('question')}, {_BYTES.format('candidate')}))
    / greatest(length(question), length(candidate)) AS score FROM candidates WHERE candidate IS NOT NULL),
best AS (SELECT item_id, arg_max(candidate, (score, -pos)) AS best_candidate, max(score) AS best_score FROM scores GROUP BY item_id)"""
_LABEL = """CASE WHEN len(logits) = 3 THEN ['contradiction', 'neutral', 'entailment'][list_position(logits, list_max(logits))] END"""
_GATE = """CASE WHEN coalesce(predicted_sql, '') = '' THEN 'sql_empty' WHEN contains(predicted_sql, 'ERROR') THEN 'sql_failed'
  WHEN NOT regexp_matches(upper(trim(predicted_sql)), '^(SELECT|WITH)') THEN 'sql_bad_start' END"""

ORACLES = {
    "C1_strip_fences": f"""SELECT item_id, regexp_replace(CASE item_id % 5
        WHEN 0 THEN split_part(split_part(response, '```sql', 2), '```', 1) WHEN 1 THEN split_part(split_part(response, '```json', 2), '```', 1)
        WHEN 2 THEN substring(response, 4, length(response) - 6) WHEN 3 THEN split_part(response, '```sql', 2) ELSE response END,
        '^\\s+|\\s+$', '', 'g') AS response FROM ({_FENCED}) f""",
    "C2_parse_candidates": f"WITH {_CANDIDATES} SELECT item_id, pos, candidate, parse_code FROM candidates",
    "C3_gate": f"SELECT test_case_id, {_GATE} AS gate_code FROM {{trips}} t",
    "C4_pair_scores": f"WITH {_SCORES} SELECT item_id, pos, score FROM scores",
    "C5_best_candidate": f"WITH {_SCORES} SELECT * FROM best",
    "C6_label": f"SELECT item_id, {_LABEL} AS label, CASE WHEN len(logits) <> 3 THEN 'nli_shape' END AS error_code FROM ({_LOGITS['duck']}) l",
    "C7_entailment_score": f"""SELECT item_id, CASE WHEN len(logits) = 3 THEN logits[3]::DOUBLE END AS score,
        CASE WHEN len(logits) <> 3 THEN 'nli_shape' END AS error_code FROM ({_LOGITS['duck']}) l""",
    "C8_result_row": rf"""WITH {_SCORES}, tests AS ({_TESTS}), gated AS (SELECT *, {_GATE} AS gate_code FROM tests)
        SELECT g.item_id, predicted_sql, coalesce(gate_code, CASE g.item_id % 4 WHEN 1 THEN 'not_a_list' WHEN 2 THEN 'json_parse_fallback' END) AS candidate_code,
          CASE WHEN gate_code IS NOT NULL THEN 0 ELSE [3, 0, 1, 1][g.item_id % 4 + 1] END AS n_candidates,
          CASE WHEN gate_code IS NULL THEN best_candidate END AS best_candidate, CASE WHEN gate_code IS NULL THEN best_score END AS best_score,
          CASE WHEN gate_code IS NULL AND best_score IS NOT NULL THEN {_LABEL} END AS label,
          CASE WHEN gate_code IS NOT NULL OR best_score IS NULL THEN 'no_best_question' WHEN len(logits) = 3 THEN NULL ELSE 'nli_shape' END AS label_code,
          round(tts_time_sec, 3) AS tts_time_sec, round(stt_time_sec, 3) AS stt_time_sec,
          CAST(len(list_filter(string_split_regex(question, '\s+'), lambda t: t <> '')) AS INT) AS tts_input_tokens,
          CAST(len(list_filter(string_split_regex(coalesce(predicted_sql, ''), '\s+'), lambda t: t <> '')) AS INT) AS tts_output_tokens
        FROM gated g LEFT JOIN best b ON g.item_id = b.item_id LEFT JOIN ({_LOGITS['duck']}) l ON g.item_id = l.item_id""",
    "C9_vector_best": f"""SELECT vec_id, arg_max(candidate_id, (score, -pos)) AS best_candidate, round(max(score), 6) AS best_score FROM (
        SELECT n.vec_id, pos, candidate_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
          / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
        FROM ({_NEAR}) n JOIN embeddings a ON n.vec_id = a.vec_id JOIN embeddings b ON n.candidate_id = b.vec_id) s GROUP BY vec_id""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
