"""Inputs derived from the given tables, written once as SQL both engines read.

``{name}`` stands for a table or another derived input.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: The given tables' names in SQL; a database may hold others.
GIVEN = ", ".join(f"'{name}'" for name in TABLES)

DERIVED = {
    # Expected and generated results per nation. By case_id % 5: 0 equal, 1 wrong value,
    # 2 extra column, 3 missing row, 4 duplicated row.
    "gold_rows": """
SELECT c_nationkey AS case_id, o_orderstatus AS k, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS v
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderstatus""",
    "gen_rows": """
SELECT g.case_id, g.k, g.v + CASE WHEN g.case_id % 5 = 1 AND g.k = 'F' THEN 1 ELSE 0 END AS v,
       CASE WHEN g.case_id % 5 = 2 THEN g.v % 97 END AS extra
FROM {gold_rows} g WHERE NOT (g.case_id % 5 = 3 AND g.k = 'P')
UNION ALL SELECT case_id, k, v, CAST(NULL AS BIGINT) FROM {gold_rows} t WHERE case_id % 5 = 4 AND k = 'O'""",
    # Row-sized results: one case per supplier, a row per line.
    "gold_lines": """
SELECT l_suppkey AS case_id, l_orderkey * 8 + l_linenumber AS pos, l_orderkey, l_quantity, l_returnflag
FROM {lineitem}""",
    "gen_lines": """
SELECT l_suppkey AS case_id, l_orderkey * 8 + l_linenumber AS pos, l_orderkey,
       l_quantity + CASE WHEN l_suppkey % 5 = 1 AND l_linenumber = 7 THEN 1 ELSE 0 END AS l_quantity, l_returnflag
FROM {lineitem} WHERE NOT (l_suppkey % 5 = 3 AND l_quantity > 49)""",
    "questions": """
SELECT event_id AS case_id, event_type,
       CASE event_id % 4 WHEN 0 THEN concat('Show every ', event_type, ' in order of value')
         WHEN 1 THEN concat('How many ', event_type, ' events has user ', CAST(user_id AS VARCHAR(20)), '?')
         WHEN 2 THEN concat('Sort the users by ', event_type) ELSE concat('List the border of ', event_type) END AS question,
       CASE WHEN event_id % 3 = 0 THEN 'order_by' ELSE 'default' END AS query_category,
       concat('SELECT user_id, value FROM events WHERE event_type = ''', event_type, '''',
         CASE event_id % 5 WHEN 0 THEN ' ORDER BY e.value DESC, user_id'
           WHEN 1 THEN concat(' order by value', chr(10), ', ts desc limit ', CAST(user_id AS VARCHAR(20)))
           WHEN 2 THEN ' ORDER BY round(value, 2) ASC;' ELSE '' END) AS query
FROM {events}""",
    "alternative_cases": """
SELECT event_id AS case_id,
       concat('SELECT {user_id, ', event_type, '_count} FROM events GROUP BY {}; SELECT {a, b, c} FROM t WHERE id = ',
              CAST(user_id AS VARCHAR(20)), ' ; ;', CASE WHEN event_id % 2 = 0 THEN 'SELECT 1 FROM events' ELSE '' END) AS query
FROM {events}""",
    "runs": """
SELECT user_id % 10 AS model, event_id AS case_id, ts AS finished_at,
       CASE WHEN event_type = 'signup' THEN 0.0 ELSE value / 100 END AS latency_seconds,
       CAST(event_id % 50 AS INT) AS input_tokens,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN
         CASE WHEN event_id % 6 = 0 THEN 'PROMPT GENERATION FAILED: no file' ELSE 'generation failed' END
         ELSE '' END AS generation_error_msg,
       CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 1 ELSE 0 END AS error_db_exec,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS correct,
       CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS exact_match
FROM {events}""",
    "trips": """
SELECT event_id AS test_case_id, user_id % 10 AS model, ts AS started_at, value / 100 AS tts_time_sec, value / 50 AS stt_time_sec,
       CASE WHEN event_id % 11 = 0 THEN 'ERROR_TTS: no answer' WHEN event_id % 13 = 0 THEN NULL
         ELSE concat('SELECT value FROM events WHERE user_id = ', CAST(user_id AS VARCHAR(20))) END AS predicted_sql,
       CASE WHEN event_id % 7 = 0 THEN 'ERROR_STT_API: no answer' ELSE event_type END AS regenerated,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 100 END AS score,
       CASE WHEN event_id % 34 = 0 THEN 'score_failed' END AS score_error,
       CASE WHEN event_id % 17 = 0 THEN 'ERROR_NO_BEST_Q' WHEN event_id % 19 = 0 THEN 'ERROR_NLI_SHAPE'
         WHEN event_type = 'click' THEN 'entailment' WHEN event_type = 'error' THEN 'contradiction' ELSE 'neutral' END AS label
FROM {events}""",
    "query_log": """
SELECT event_id AS query_id, user_id, CASE event_id % 18
  WHEN 0 THEN concat('SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > ', CAST(user_id AS VARCHAR(20)))
  WHEN 1 THEN 'SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey'
  WHEN 2 THEN concat('SELECT p_name FROM part LIMIT ', CAST(user_id AS VARCHAR(20)))
  WHEN 3 THEN 'DROP TABLE orders'
  WHEN 4 THEN 'SELECT n_name FROM nation; SELECT r_name FROM region'
  WHEN 5 THEN 'SELECT c_name FROM customer JOIN orders'
  WHEN 6 THEN 'SELECT s_name, s_rating FROM supplier'
  WHEN 7 THEN 'SELECT stock FROM inventory'
  WHEN 8 THEN 'WITH w AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM w WHERE n > 10'
  WHEN 9 THEN 'SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem'
  WHEN 10 THEN 'SELECT 1'
  WHEN 11 THEN 'UPDATE orders SET o_totalprice = 0; -- xp_cmdshell'
  WHEN 12 THEN 'SELECT o_orderkey FROM orders WHERE o_orderstatus = ''update; drop'''
  WHEN 13 THEN 'SELECT l.l_quantity, p.p_name FROM lineitem AS l JOIN part AS p USING (p_partkey)'
  WHEN 14 THEN 'WITH w AS (SELECT s_suppkey AS k FROM supplier) SELECT n.n_title, w.k FROM nation n JOIN w ON n.n_nationkey = w.k'
  WHEN 15 THEN 'SELECT "r_name" FROM "main"."region" ORDER BY r_name DESC LIMIT 3'
  WHEN 16 THEN 'SELECT resp_code FROM orders WHERE exec (1) = 2'
  ELSE 'SELECT FROM nation' END AS sql
FROM {events}""",
    "checks": """
SELECT user_id AS check_id, event_id, ts, 'Hi' AS expected,
       CASE event_type WHEN 'error' THEN concat('fault ', CAST(event_id % 2 AS VARCHAR(10)))
                       WHEN 'view' THEN 'Rate limit exceeded' ELSE 'Hi' END AS response,
       CAST(NULL AS VARCHAR(10)) AS error,
       value / 100 AS latency, CAST(event_id % 50 AS INT) AS tokens_in, CAST(event_id % 7 AS INT) AS tokens_out,
       CASE WHEN event_id % 97 = 0 THEN 503 WHEN event_id % 89 = 0 THEN NULL ELSE 200 END AS http_status
FROM {events}""",
    "pairs": """
SELECT a.conv_id * 100 + a.turn AS pair_id, a.text AS output, u.text AS reference
FROM {conversations} a JOIN {conversations} u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE a.role = 'assistant' AND u.role = 'user'""",
    "responses": """
SELECT doc_id AS item_id, CASE doc_id % 4
  WHEN 0 THEN concat('{"score": ', CAST(quality * 8 AS VARCHAR(10)), ', "reason": "r"}')
  WHEN 1 THEN concat('{"score": "0.', CAST(toxic AS VARCHAR(10)), '", "reason": "r", "categories": "x"}')
  WHEN 2 THEN '{"reason": "no score"}'
  ELSE 'score: 7' END AS response
FROM {labels}""",
    "candidate_lists": """
SELECT doc_id AS item_id, text AS question, CASE doc_id % 4
  WHEN 0 THEN '["show the first rows", "list rows", "what are the rows"]'
  WHEN 1 THEN '{"q": "not a list"}'
  WHEN 2 THEN concat('plain question about ', source)
  ELSE concat('["', lang, '"]') END AS response
FROM {documents}""",
}

_PLACE = re.compile(r"\{(\w+)\}")


def expand(text: str, table: Callable[[str], str]) -> str:
    """Put tables and derived inputs in their places."""

    def put(match: re.Match) -> str:
        name = match.group(1)
        if name in TABLES:
            return table(name)
        if name in DERIVED:
            return f"({expand(DERIVED[name], table)})"
        return match.group(0)

    return _PLACE.sub(put, text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(expand(DERIVED[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(text: str) -> str:
    """The same text for an engine that has the tables as views."""
    return expand(text, lambda t: t).strip()
