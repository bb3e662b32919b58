"""Prompt tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import prompts as pr
from sqlassay.plans.audits import _SCRIPTS, ddl_scripts, given_catalog
from sqlassay.plans.fixtures import GIVEN, expand, oracle
from sqlassay.sources.cases import case_files

_CASES = """SELECT event_id AS case_id, concat('How many ', event_type, ' {rows}?') AS question,
  CASE event_id % 3 WHEN 0 THEN concat('Return one row. Use ', event_type, '. No joins.') WHEN 1 THEN '' END AS instructions,
  CASE event_id % 2 WHEN 0 THEN concat(event_type, ': kind of event') ELSE '' END AS glossary,
  CASE event_id % 4 WHEN 0 THEN concat('Q: one', chr(92), 'nSQL: SELECT ', CAST(user_id AS VARCHAR(20))) ELSE '' END AS k_shot_prompt,
  CASE event_id % 5 WHEN 0 THEN 'events.csv' WHEN 1 THEN 'orders.csv, customer.csv' WHEN 2 THEN 'part.csv,missing.csv , '
    WHEN 3 THEN '' ELSE 'region.csv' END AS data_csv_files FROM {events}"""
_TABLES = """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS schema_id, p_partkey % 8 AS table_no, CASE p_partkey % 4
  WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat(replace(p_name, ' ', 'X'), CAST(p_size AS VARCHAR(20)))
  WHEN 2 THEN concat('shop.', replace(p_name, ' ', '__')) ELSE concat('all_', substring(p_name, 1, 1), '_', p_type) END AS table_name FROM {part}"""


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(expand(text, lambda t: f"parquet.`{d}/{t}.parquet`"))


def p1(spark: SparkSession, d: str) -> DataFrame:
    return pr.decorate(_sql(spark, d, _CASES)).select("case_id", "instructions", "glossary", "k_shot_prompt")


def p2(spark: SparkSession, d: str) -> DataFrame:
    cases = _sql(spark, d, _CASES)
    return pr.case_schema(case_files(cases), given_catalog(spark, d), cases)


_CATALOGS = """SELECT schema_id, table_name, ordinal, column_name, 'TEXT' AS type_class FROM (@) t
  JOIN (SELECT 0 AS ordinal, 'id' AS column_name UNION ALL SELECT 1, 'unit price' UNION ALL SELECT 2, 'note') c ON 1 = 1""".replace("@", _TABLES)


def p3(spark: SparkSession, d: str) -> DataFrame:
    tables = _sql(spark, d, _TABLES).dropDuplicates(["schema_id", "table_name"])
    columns = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name")) for i, n in enumerate(["id", "unit price", "note"])])
    catalog = tables.select("schema_id", "table_name", F.explode(columns).alias("c"), F.lit("TEXT").alias("type_class"))
    return pr.shuffle_schema(catalog.select("schema_id", "table_name", "c.*", "type_class"), seed=42)


def p4(spark: SparkSession, d: str) -> DataFrame:
    return pr.aliases(_sql(spark, d, _TABLES))


def p5(spark: SparkSession, d: str) -> DataFrame:
    return pr.alias_text(p4(spark, d))


def p6(spark: SparkSession, d: str) -> DataFrame:
    cases = pr.decorate(_sql(spark, d, _CASES))
    with_schema = cases.join(pr.case_schema(case_files(cases), given_catalog(spark, d)), "case_id", "left")
    return pr.prompts(with_schema).select("case_id", "prompt")


def p7(spark: SparkSession, d: str) -> DataFrame:
    return pr.table_names(ddl_scripts(spark, d))


_METADATA = "SELECT schema_id, concat(ddl, chr(10), '  last INT, ', chr(10), ');', chr(10), 'Here is a list of joinable columns: a, b') AS ddl FROM (@) s".replace("@", _SCRIPTS)


def p8(spark: SparkSession, d: str) -> DataFrame:
    return pr.clean_metadata(_sql(spark, d, _METADATA))


QUERIES = {
    "P1_decorate": p1, "P2_case_schema": p2, "P3_shuffle_schema": p3, "P4_aliases": p4,
    "P5_alias_text": p5, "P6_fill_template": p6, "P7_table_names": p7, "P8_clean_metadata": p8,
}

_DECORATED = f"""decorated AS (SELECT case_id, question, data_csv_files,
  CASE WHEN coalesce(instructions, '') <> '' THEN concat(chr(10), 'Follow the instructions below to generate the query:', chr(10),
    replace(instructions, '. ', concat('.', chr(10))), chr(10)) ELSE '' END AS instructions,
  CASE WHEN glossary <> '' THEN concat(chr(10), 'Use the following glossary terms if relevant:', chr(10), glossary, chr(10)) ELSE '' END AS glossary,
  CASE WHEN k_shot_prompt <> '' THEN concat(chr(10), 'Refer to these examples:', chr(10),
    replace(k_shot_prompt, concat(chr(92), 'n'), chr(10)), chr(10)) ELSE '' END AS k_shot_prompt FROM ({_CASES}) c)"""
_SCHEMAS = f"""ddl AS (SELECT table_name, concat('CREATE TABLE ', table_name, ' (', chr(10),
    string_agg(concat('  ', column_name, ' ', CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER'
      WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' ELSE 'TEXT' END), concat(',', chr(10)) ORDER BY ordinal_position), chr(10), ');', chr(10)) AS text
    FROM information_schema.columns WHERE table_name IN ({GIVEN}) GROUP BY table_name),
files AS (SELECT case_id, unnest(string_split(data_csv_files, ',')) AS file, generate_subscripts(string_split(data_csv_files, ','), 1) AS file_no FROM ({_CASES}) c),
schemas AS (SELECT case_id, coalesce(string_agg(text, '' ORDER BY file_no), '') AS schema_string FROM files
  LEFT JOIN ddl ON table_name = replace(trim(file), '.csv', '') GROUP BY case_id)"""
_PROMPT = pr.TEMPLATE.replace("'", "''").replace("{db_type}", "spark")
for _place, _value in {
    "user_question": "question",
    "table_metadata_string": "coalesce(schema_string, '')",
    "instructions": "CASE WHEN instructions <> '' THEN instructions ELSE 'Generate the SQL query.' END",
    "glossary": "glossary",
    "k_shot_prompt": "k_shot_prompt",
    "prev_invalid_sql": "'N/A'",
    "prev_error_msg": "'N/A'",
    "table_aliases": "'-- No aliases provided.'",
}.items():
    _PROMPT = _PROMPT.replace(f"{{{_place}}}", f"', {_value}, '")
_RESERVED = (
    "['abs','all','and','any','avg','as','at','asc','bit','by','day','dec','do','div','end','for','go','in','is','not','or','to']"
)
_ALIASES = f"""aliased AS (
  WITH RECURSIVE named AS (SELECT schema_id, table_no, table_name, regexp_replace(table_name, '^.*\\.', '') AS n FROM ({_TABLES}) t),
  first AS (SELECT *, lower(CASE WHEN contains(n, '_') THEN array_to_string(list_transform(list_filter(string_split(n, '_'), lambda w: w <> ''), lambda w: w[1]), '')
      ELSE concat(regexp_replace(concat(upper(n[1]), n[2:]), '[^A-Z]', '', 'g'), regexp_extract(n, '(\\d+)$', 1)) END) AS a FROM named),
  walk AS (
    SELECT schema_id, CAST(-1 AS BIGINT) AS table_no, '' AS table_name, '' AS alias, {_RESERVED} AS used FROM first GROUP BY schema_id
    UNION ALL
    SELECT schema_id, table_no, table_name, pick AS alias, list_append(used, pick) AS used FROM (
      SELECT w.schema_id, f.table_no, f.table_name, w.used, list_filter(list_concat([f.a, lower(f.n[1:2]), lower(f.n[1:3])],
        list_transform(range(2, 20), lambda i: concat(lower(f.n[1]), i))), lambda c: NOT list_contains(w.used, c))[1] AS pick
      FROM walk w JOIN first f ON w.schema_id = f.schema_id AND f.table_no = w.table_no + 1) s)
  SELECT schema_id, CAST(table_no AS INT) AS table_no, table_name, alias FROM walk WHERE table_no >= 0)"""

ORACLES = {
    "P1_decorate": f"WITH {_DECORATED} SELECT case_id, instructions, glossary, k_shot_prompt FROM decorated",
    "P2_case_schema": f"WITH {_SCHEMAS} SELECT case_id, schema_string FROM schemas",
    "P3_shuffle_schema": f"""SELECT schema_id,
        CAST(dense_rank() OVER (PARTITION BY schema_id ORDER BY md5(concat('42|', table_name)), table_name) - 1 AS INT) AS table_no, table_name,
        CAST(row_number() OVER (PARTITION BY schema_id, table_name ORDER BY md5(concat('42|', table_name, '|', column_name))) - 1 AS INT) AS ordinal,
        column_name, type_class FROM (SELECT DISTINCT * FROM ({_CATALOGS}) x) c""",
    "P4_aliases": f"WITH {_ALIASES} SELECT * FROM aliased",
    "P5_alias_text": f"""WITH {_ALIASES} SELECT schema_id, string_agg(concat('-- ', table_name, ' AS ', alias, chr(10)), '' ORDER BY table_no)
        AS table_aliases FROM aliased GROUP BY schema_id""",
    "P6_fill_template": f"""WITH {_DECORATED}, {_SCHEMAS}
        SELECT d.case_id, concat('{_PROMPT}') AS prompt FROM decorated d LEFT JOIN schemas s ON d.case_id = s.case_id""",
    "P7_table_names": f"""SELECT schema_id, 0 AS table_no, concat('"shop"."Part ', schema_id, '"') AS table_name FROM ({_SCRIPTS}) s""",
    "P8_clean_metadata": rf"""SELECT schema_id, regexp_replace(split_part(replace(replace(regexp_replace(ddl, '--[^\n]*', '', 'g'),
          concat(', ', chr(10), ');'), concat(chr(10), ');')), concat(',', chr(10), ');'), concat(chr(10), ');')),
          'Here is a list of joinable columns:', 1), '^\s+|\s+$', '', 'g') AS ddl FROM ({_METADATA}) s""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
