"""Query-log audit over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import audit, summary
from sqlassay.plans.fixtures import GIVEN, TABLES, derived, expand, oracle, table
from sqlassay.sources.results import metrics_wide
from sqlassay.sources.tables import infer_catalog


def given_catalog(spark: SparkSession, d: str) -> DataFrame:
    return infer_catalog({name: table(spark, d, name) for name in TABLES})


def _log(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "query_log")


def _issues(*rules: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return audit.audit(_log(spark, d)).filter(F.col("rule").isin(*rules)).select("query_id", "severity", "message")

    return run


def q8(spark: SparkSession, d: str) -> DataFrame:
    return audit.issue_report(_log(spark, d))


def q9(spark: SparkSession, d: str) -> DataFrame:
    return audit.safety_score(_log(spark, d))


def q10(spark: SparkSession, d: str) -> DataFrame:
    return audit.table_refs(_log(spark, d))


def q11(spark: SparkSession, d: str) -> DataFrame:
    return audit.column_refs(_log(spark, d))


def q12(spark: SparkSession, d: str) -> DataFrame:
    return audit.unknown_tables(audit.table_refs(_log(spark, d)), given_catalog(spark, d))


def q13(spark: SparkSession, d: str) -> DataFrame:
    return audit.unknown_columns(_log(spark, d), given_catalog(spark, d))


_NO_TABLE_LOG = """SELECT event_id AS query_id, CASE event_id % 4 WHEN 0 THEN concat('SELECT ', CAST(user_id AS VARCHAR(20)))
  WHEN 1 THEN concat('SELECT ', event_type) WHEN 2 THEN 'SELECT count(*), now()' ELSE 'SELECT value FROM events' END AS sql
  FROM {events}"""


def q14(spark: SparkSession, d: str) -> DataFrame:
    log = spark.sql(expand(_NO_TABLE_LOG, lambda t: f"parquet.`{d}/{t}.parquet`"))
    return audit.no_table_check(log)


_SCRIPTS = """SELECT p_partkey AS schema_id, concat(
  '/* parts, (old) */ CREATE TABLE "shop"."Part ', CAST(p_partkey AS VARCHAR(20)), '" (', chr(10),
  '  id INT PRIMARY KEY, "Unit Price" DECIMAL(10, 2) NOT NULL, -- price, net', chr(10),
  '  note VARCHAR(', CAST(p_size AS VARCHAR(20)), ') CHECK (note IN (1, 2, 3)), PRIMARY KEY (id, note));', chr(10),
  'CREATE OR REPLACE VIEW v_', replace(p_name, ' ', '_'), ' AS (SELECT a.id, max(a.price, 0) AS top, b."Name" FROM a JOIN b ON a.id = b.id);',
  'CRTE TBLE bad (id INT);') AS ddl FROM {part}"""


def ddl_scripts(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(expand(_SCRIPTS, lambda t: f"parquet.`{d}/{t}.parquet`"))


def q15(spark: SparkSession, d: str) -> DataFrame:
    return audit.ddl_catalog(ddl_scripts(spark, d))


def q16(spark: SparkSession, d: str) -> DataFrame:
    return audit.query_verdict(_log(spark, d), given_catalog(spark, d))


def q17(spark: SparkSession, d: str) -> DataFrame:
    return audit.hallucination(_log(spark, d), given_catalog(spark, d))


_ITEMS = """SELECT query_id, sql, concat('Question ', CAST(query_id AS VARCHAR(20))) AS use_case,
  CASE query_id % 3 WHEN 0 THEN concat('{"score": ', CAST(query_id % 11 AS VARCHAR(20)), ', "reason": "r"}')
    WHEN 1 THEN '{"score": 0.5}' ELSE 'score: 7' END AS judge_response FROM {query_log} q"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(expand(_ITEMS, lambda t: f"parquet.`{d}/{t}.parquet`"))


def q18(spark: SparkSession, d: str) -> DataFrame:
    return audit.sql_metrics(_items(spark, d), given_catalog(spark, d))


WIDE_METRICS = [audit.HALLUCINATION, audit.SAFETY, audit.JUDGED, audit.VALIDATION]


def s7(spark: SparkSession, d: str) -> DataFrame:
    return metrics_wide(q18(spark, d), "query_id", WIDE_METRICS)


def a10(spark: SparkSession, d: str) -> DataFrame:
    expected = F.when((F.col("query_id") % 18).isin(0, 1, 8, 10, 12, 13, 15), "Pass").otherwise("Fail")
    actual = F.when(F.col("score") == 0, "Pass").otherwise("Fail")
    return summary.tally(q16(spark, d).select(expected.alias("expected"), actual.alias("actual")))


def a11(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    scores = audit.sql_metrics(items, given_catalog(spark, d), strict=True)
    wide = metrics_wide(scores, "query_id", [audit.VALIDATION, audit.JUDGED])
    wide = wide.join(items.select("query_id", "use_case"), "query_id").withColumnRenamed("query_id", "test_id")
    return summary.validity_summary(wide, "comprehensive_sql_validation_score", "llm_based_sql_evaluation_geval_score")


QUERIES = {
    "Q1_statement_kind": _issues("statement_kind"),
    "Q2_disallowed_words": _issues("disallowed_word"),
    "Q3_unsafe_patterns": _issues("unsafe_pattern"),
    "Q4_limit_without_order": _issues("limit_without_order"),
    "Q5_inner_semicolon": _issues("inner_semicolon"),
    "Q6_join_without_condition": _issues("open_join"),
    "Q7_union_notice": _issues("union"),
    "Q8_issue_report": q8, "Q9_safety_score": q9, "Q10_table_refs": q10, "Q11_column_refs": q11,
    "Q12_unknown_tables": q12, "Q13_unknown_columns": q13, "Q14_no_table_queries": q14, "Q15_ddl_catalog": q15,
    "Q16_query_verdict": q16, "Q17_hallucination_score": q17, "Q18_sql_metrics": q18, "S7_metric_wide": s7,
    "A10_expected_tally": a10, "A11_validity_summary": a11,
}

# Literals out of the text, as the rules read it.
_LINT = r"""lint AS (SELECT query_id, regexp_replace(sql, '(''[^'']*(?:''''[^'']*)*'')|(--[^\n]*)', '\2', 'g') AS t
  FROM {query_log} q)"""

_WORDS = "(VALUES " + ", ".join(
    f"('{w}')" for w in ["DROP", "DELETE", "TRUNCATE", "UPDATE", "INSERT", "ALTER", "CREATE", "GRANT", "REVOKE"]
) + ") w(word)"
_UNSAFE = r"(VALUES ('(?i)\bxp_cmdshell'), ('(?i)\bexec[\s(]'), ('(?i)\bsp_'), ('(?i)\bxp_'), (';\s*--')) u(pattern)"
_MATCHED = "replace(trim(regexp_extract(t, pattern)), '(', '')"

_ALL_ISSUES = rf"""WITH {_LINT}, found AS (
  SELECT query_id, 1 AS rule_no, 'error' AS severity, 'Only SELECT statements or CTEs (WITH...SELECT) are allowed.' AS message
    FROM lint WHERE NOT regexp_matches(t, '(?is)^\s*(select\b|with\s+.*?\s+as\s*\(.*?\)\s*select\b)')
  UNION ALL SELECT query_id, 10, 'error', concat('Potential disallowed operation detected: ''', word, '''.')
    FROM lint JOIN {_WORDS} ON regexp_matches(t, concat('(?i)\b', word, '\b'))
  UNION ALL SELECT query_id, 20, 'error', concat('Potentially unsafe SQL pattern ''', {_MATCHED}, ''' detected.')
    FROM lint JOIN {_UNSAFE} ON regexp_matches(t, pattern)
  UNION ALL SELECT query_id, 30, 'error', 'Use of LIMIT/OFFSET without ORDER BY may result in unpredictable results.'
    FROM lint WHERE regexp_matches(t, '(?i)\b(limit|offset)\b') AND NOT regexp_matches(t, '(?i)\border\s+by\b')
  UNION ALL SELECT query_id, 31, 'error', 'Avoid the use of semicolons (;) except possibly at the very end of the query.'
    FROM lint WHERE regexp_matches(regexp_replace(trim(t), ';\s*(--[^\n]*)?$', ''), ';')
  UNION ALL SELECT query_id, 32, 'error', 'Use of JOIN without an ON/USING clause may result in a Cartesian product. Specify join conditions or use CROSS JOIN.'
    FROM lint WHERE len(list_filter(string_split_regex(t, '(?i)\bjoin\b')[2:], lambda s: NOT regexp_matches(s, '(?i)\b(on|using)\b'))) > 0
  UNION ALL SELECT query_id, 33, 'notice', 'UNION queries detected. Ensure column counts and types match in each SELECT.'
    FROM lint WHERE regexp_matches(t, '(?i)\bunion\b'))"""


def _issue_oracle(low: int, high: int) -> str:
    return f"{_ALL_ISSUES} SELECT query_id, severity, message FROM found WHERE rule_no BETWEEN {low} AND {high}"


# What a reader finds in each kind of statement of the log: tables and columns.
_TABLE_TRUTH = """(VALUES (0, 'customer'), (1, 'customer'), (1, 'orders'), (2, 'part'), (4, 'nation'), (4, 'region'),
  (5, 'customer'), (5, 'orders'), (6, 'supplier'), (7, 'inventory'), (8, 'part'), (9, 'orders'), (9, 'lineitem'),
  (12, 'orders'), (13, 'lineitem'), (13, 'part'), (14, 'supplier'), (14, 'nation'), (15, 'region'), (16, 'orders')
  ) t(kind, table_name)"""
_COLUMN_TRUTH = """(VALUES (0, NULL, 'c_name'), (0, NULL, 'c_acctbal'), (1, 'c', 'c_name'), (1, 'o', 'o_totalprice'),
  (1, 'c', 'c_custkey'), (1, 'o', 'o_custkey'), (2, NULL, 'p_name'), (4, NULL, 'n_name'), (4, NULL, 'r_name'),
  (5, NULL, 'c_name'), (6, NULL, 's_name'), (6, NULL, 's_rating'), (7, NULL, 'stock'), (9, NULL, 'o_orderkey'),
  (9, NULL, 'l_orderkey'), (12, NULL, 'o_orderkey'), (12, NULL, 'o_orderstatus'), (13, 'l', 'l_quantity'),
  (13, 'p', 'p_name'), (13, NULL, 'p_partkey'), (14, 'n', 'n_title'), (14, 'n', 'n_nationkey'), (15, NULL, 'r_name'),
  (16, NULL, 'resp_code')) c(kind, qualifier, column_name)"""
_DEFINED = f"(SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({GIVEN}))"
_NAMES = f"""names AS (
  SELECT query_id, query_id % 18 AS kind, (query_id % 18) IN (3, 11, 17) AS unparsed,
    list_sort(coalesce((SELECT list(table_name) FROM {_TABLE_TRUTH} WHERE kind = query_id % 18), [])) AS tables
  FROM {{query_log}} q),
missing AS (
  SELECT kind, list_sort(list(table_name)) AS unknown_tables FROM {_TABLE_TRUTH}
  WHERE table_name NOT IN (SELECT table_name FROM {_DEFINED}) GROUP BY kind),
undefined AS (
  SELECT kind, list_sort(list(DISTINCT column_name)) AS unknown_columns FROM {_COLUMN_TRUTH}
  WHERE kind NOT IN (SELECT kind FROM missing) AND column_name NOT IN (
    SELECT d.column_name FROM {_DEFINED} d JOIN {_TABLE_TRUTH} ON d.table_name = t.table_name AND t.kind = c.kind) GROUP BY kind)"""
_REPORT = """report AS (SELECT query_id, count(*) AS n_issues, concat('Detected issues while validating SQL query:', chr(10),
  string_agg(concat('- ', message), chr(10) ORDER BY rule_no, strpos('DROP DELETE TRUNCATE UPDATE', split_part(message, '''', 2)),
    CASE WHEN message LIKE '%xp_cmdshell%' THEN 1 WHEN message LIKE '%xp_%' THEN 2 ELSE 3 END)) AS report
  FROM found GROUP BY query_id)"""
_VERDICT = f"""{_ALL_ISSUES}, {_NAMES}, {_REPORT},
verdict AS (SELECT n.query_id, coalesce(report,
  CASE WHEN unparsed THEN 'Validation Error: Failed to parse the query structure.'
    WHEN unknown_tables IS NOT NULL THEN concat('Validation Error: Query references undefined tables: ', array_to_string(unknown_tables, ', '))
    WHEN unknown_columns IS NOT NULL THEN concat('Validation Error: Columns [', array_to_string(unknown_columns, ', '),
      '] are not defined for the referenced tables [', array_to_string(tables, ', '), ']') END) AS reason
  FROM names n LEFT JOIN report r ON n.query_id = r.query_id LEFT JOIN missing m ON n.kind = m.kind LEFT JOIN undefined u ON n.kind = u.kind)"""
_HALLUCINATION = """hallucination AS (SELECT query_id, CASE WHEN unparsed THEN 'Query unparsable, cannot check for column hallucination'
    WHEN unknown_tables IS NOT NULL THEN concat('Query references undefined tables: ', array_to_string(unknown_tables, ', '), '.')
    WHEN len(tables) = 0 THEN 'Pass (No tables queried)'
    WHEN unknown_columns IS NOT NULL THEN concat('Query references undefined columns: ', array_to_string(unknown_columns, ', '), ' for the queried tables.')
    ELSE 'Pass' END AS reason
  FROM names n LEFT JOIN missing m ON n.kind = m.kind LEFT JOIN undefined u ON n.kind = u.kind)"""
_SAFETY = r"""safety AS (SELECT query_id, CASE
  WHEN regexp_matches(t, '(?i)\bdrop\b') THEN 'Prohibited modification keyword: ''DROP'''
  WHEN regexp_matches(t, '(?i)\bupdate\b') THEN 'Prohibited modification keyword: ''UPDATE'''
  WHEN regexp_matches(t, '(?i)exec\s*\(') THEN 'Potentially unsafe pattern/keyword detected: ''EXEC direct call'''
  WHEN regexp_matches(regexp_replace(trim(t), ';\s*(--[^\n]*)?\s*$', ''), ';')
    THEN 'Potentially unsafe pattern: ''Comment after semicolon (potential injection hiding)'' (semicolon not at query end)'
  ELSE 'Pass' END AS reason FROM lint)"""
_JUDGED = """judged AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN CASE WHEN query_id % 11 > 1 THEN (query_id % 11) / 10 ELSE query_id % 11 END
    WHEN 1 THEN 0.5 ELSE 0.0 END AS score,
  CASE query_id % 3 WHEN 0 THEN CASE WHEN query_id % 11 > 1 THEN concat('(Score normalized from ', CAST(CAST(query_id % 11 AS DOUBLE) AS VARCHAR), '/10) r') ELSE 'r' END
    WHEN 1 THEN 'No reason provided by judge.' ELSE 'Error parsing judge response. Response: ''score: 7''' END AS reason FROM {query_log} q)"""
_METRICS = f"""{_ALL_ISSUES}, {_NAMES}, {_HALLUCINATION}, {_SAFETY}, {_JUDGED},
metrics AS (
  SELECT query_id, 'SQL Column Hallucination' AS name, CASE WHEN reason LIKE 'Pass%' THEN 0.0 ELSE 1.0 END::DOUBLE AS score, reason FROM hallucination
  UNION ALL SELECT query_id, 'Query Safety Audit', CASE WHEN reason = 'Pass' THEN 0.0 ELSE 1.0 END::DOUBLE, reason FROM safety
  UNION ALL SELECT query_id, 'LLM-based SQL Evaluation (GEval)', score::DOUBLE, reason FROM judged)"""


def _column(name: str, slug: str) -> str:
    return ", ".join(
        f"max(CASE WHEN name = '{name}' THEN {part} END) AS {slug}_{part}" for part in ("score", "reason")
    )


ORACLES = {
    "Q1_statement_kind": _issue_oracle(1, 1),
    "Q2_disallowed_words": _issue_oracle(10, 10),
    "Q3_unsafe_patterns": _issue_oracle(20, 20),
    "Q4_limit_without_order": _issue_oracle(30, 30),
    "Q5_inner_semicolon": _issue_oracle(31, 31),
    "Q6_join_without_condition": _issue_oracle(32, 32),
    "Q7_union_notice": _issue_oracle(33, 33),
    "Q8_issue_report": f"{_ALL_ISSUES}, {_REPORT} SELECT q.query_id, CAST(coalesce(n_issues, 0) AS INT) AS n_issues, report FROM {{query_log}} q LEFT JOIN report r ON q.query_id = r.query_id",
    "Q9_safety_score": f"WITH {_LINT}, {_SAFETY} SELECT query_id, CASE WHEN reason = 'Pass' THEN 0.0 ELSE 1.0 END::DOUBLE AS score, reason FROM safety",
    "Q10_table_refs": f"""SELECT query_id, (query_id % 18) IN (3, 11, 17) AS unparsed, table_name FROM {{query_log}} q
        LEFT JOIN {_TABLE_TRUTH} ON query_id % 18 = kind WHERE kind IS NOT NULL OR (query_id % 18) IN (3, 11, 17)""",
    "Q11_column_refs": f"SELECT query_id, qualifier, column_name FROM {{query_log}} q JOIN {_COLUMN_TRUTH} ON query_id % 18 = kind",
    "Q12_unknown_tables": f"""SELECT query_id, table_name FROM {{query_log}} q JOIN {_TABLE_TRUTH} ON query_id % 18 = kind
        WHERE table_name NOT IN (SELECT table_name FROM {_DEFINED})""",
    "Q13_unknown_columns": f"""WITH {_NAMES} SELECT query_id, unnest(unknown_columns) AS column_name FROM names JOIN undefined USING (kind)""",
    "Q14_no_table_queries": """SELECT event_id AS query_id, event_id % 4 <> 1 AS passes, CASE WHEN event_id % 4 = 1 THEN
        'Validation Error: Columns specified without a valid table or CTE reference.' END AS reason FROM events WHERE event_id % 4 <> 3""",
    "Q15_ddl_catalog": """SELECT p_partkey AS schema_id, table_no,
          CASE table_no WHEN 0 THEN concat('part ', p_partkey) ELSE concat('v_', replace(p_name, ' ', '_')) END AS table_name,
          ordinal, column_name, replace(data_type, '#', CAST(p_size AS VARCHAR)) AS data_type
        FROM part CROSS JOIN (VALUES (0, 0, 'id', 'INT'), (0, 1, 'unit price', 'DECIMAL(10, 2)'), (0, 2, 'note', 'VARCHAR(#)'),
          (1, 0, 'id', ''), (1, 1, 'top', ''), (1, 2, 'name', '')) c(table_no, ordinal, column_name, data_type)""",
    "Q16_query_verdict": f"""{_VERDICT} SELECT query_id, CASE WHEN reason IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
        coalesce(reason, 'Pass (Comprehensive Validation)') AS reason FROM verdict""",
    "Q17_hallucination_score": f"{_METRICS} SELECT query_id, score, reason FROM metrics WHERE name = 'SQL Column Hallucination'",
    "Q18_sql_metrics": f"{_METRICS} SELECT * FROM metrics",
    "S7_metric_wide": f"""{_METRICS} SELECT query_id, {_column('SQL Column Hallucination', 'sql_column_hallucination')},
        {_column('Query Safety Audit', 'query_safety_audit')},
        {_column('LLM-based SQL Evaluation (GEval)', 'llm_based_sql_evaluation_geval')},
        {_column('Comprehensive SQL Validation', 'comprehensive_sql_validation')} FROM metrics GROUP BY query_id""",
    "A10_expected_tally": f"""{_VERDICT}, told AS (
          SELECT CASE WHEN query_id % 18 IN (0, 1, 8, 10, 12, 13, 15) THEN 'Pass' ELSE 'Fail' END AS expected,
            CASE WHEN reason IS NULL THEN 'Pass' ELSE 'Fail' END AS actual FROM verdict)
        SELECT expected, actual, count(*) AS cases, count(*) FILTER (expected = actual) AS correct,
          count(*) FILTER (expected <> actual) AS incorrect FROM told GROUP BY expected, actual""",
    "A11_validity_summary": f"""{_VERDICT}, {_JUDGED} SELECT v.query_id AS test_id,
          substring(concat('Question ', v.query_id), 1, 25) AS use_case,
          CASE WHEN v.reason IS NULL THEN 'Yes' ELSE 'No' END AS valid, j.score::DOUBLE AS judge_score
        FROM verdict v JOIN judged j ON v.query_id = j.query_id""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
