"""Result-table comparison over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import compare, running
from sqlassay.plans.fixtures import derived, expand, oracle, table
from sqlassay.session import landed

# Positions inside a nation's result; every seventh nation is returned backwards.
_PLACED = {
    side: f"""SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN case_id % 7 = 3
              AND '{side}' = 'gen' THEN -ascii(k) ELSE ascii(k) END) AS pos FROM {{{side}_rows}} r"""
    for side in ("gold", "gen")
}


def _placed(spark: SparkSession, d: str, side: str) -> DataFrame:
    return spark.sql(expand(_PLACED[side], lambda t: f"parquet.`{d}/{t}.parquet`"))


def nation_results(spark: SparkSession, d: str, land: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, long results, shapes) of the per-nation comparison."""
    gold = compare.to_long(_placed(spark, d, "gold"), F.col("case_id"), "gold", F.col("pos"), ["k", "v"])
    with_extra = {"extra": F.col("case_id") % 5 == 2}
    gen = compare.to_long(
        _placed(spark, d, "gen"), F.col("case_id"), "gen", F.col("pos"), ["k", "v", "extra"], present=with_extra
    )
    results = gold.unionByName(gen)
    if land:
        results = landed(results, "results")
    shapes = compare.shapes_of(results)
    cases = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("case_id"),
        F.concat(F.lit("Total value per status for "), F.col("n_name")).alias("question"),
        F.lit("default").alias("query_category"),
    )
    cases = cases.join(shapes.select("case_id").distinct(), "case_id", "left_semi")
    return cases, results, shapes


def line_results(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_orderkey", "l_quantity", "l_returnflag"]
    sides = [
        compare.to_long(derived(spark, d, f"{side}_lines"), F.col("case_id"), side, F.col("pos"), names)
        for side in ("gold", "gen")
    ]
    return sides[0].unionByName(sides[1])


def r1(spark: SparkSession, d: str) -> DataFrame:
    return compare.distinct_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


def r2(spark: SparkSession, d: str) -> DataFrame:
    return compare.sort_columns(table(spark, d, "customer"))


def r3(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return compare.dedup_names(orders.select("o_orderkey", F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("k")))


def r4(spark: SparkSession, d: str) -> DataFrame:
    return compare.order_sensitive(derived(spark, d, "questions")).select("case_id", "order_sensitive")


def r5(spark: SparkSession, d: str) -> DataFrame:
    return compare.order_keys(derived(spark, d, "questions"))


def r6(spark: SparkSession, d: str) -> DataFrame:
    return compare.round_all(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice"), 1)


def r7(spark: SparkSession, d: str) -> DataFrame:
    _, results, shapes = nation_results(spark, d)
    return compare.ordered_equal(results, shapes)


def r8(spark: SparkSession, d: str) -> DataFrame:
    return compare.set_equal(line_results(spark, d))


def r9(spark: SparkSession, d: str) -> DataFrame:
    diff = compare.multiset_diff(line_results(spark, d))
    return diff.withColumn("row", F.array_join("row", "|"))


def r10(spark: SparkSession, d: str) -> DataFrame:
    _, results, shapes = nation_results(spark, d)
    return compare.sequence_equal(results, shapes)


def r11(spark: SparkSession, d: str) -> DataFrame:
    return compare.column_match(nation_results(spark, d)[1])


def r12(spark: SparkSession, d: str) -> DataFrame:
    _, results, shapes = nation_results(spark, d)
    return compare.subset_match(results, shapes)


def r13(spark: SparkSession, d: str) -> DataFrame:
    return compare.alternatives(derived(spark, d, "alternative_cases"))


def r14(spark: SparkSession, d: str) -> DataFrame:
    return compare.expand_braces(r13(spark, d))


# Gold texts with alternatives and braces: the second alternative is right, a subset of a
# brace's columns is, one is right with further columns, none is, none can be run, the generated one cannot.
ALTERNATIVE_STATEMENTS = [
    (1, "SELECT count(*) AS n FROM nation; SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, count(*) AS c FROM nation GROUP BY n_regionkey"),
    (2, "SELECT {o_orderstatus, o_orderpriority}, max(o_totalprice) AS top FROM orders GROUP BY {}", "SELECT o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY o_orderpriority"),
    (3, "SELECT c_name FROM customer WHERE c_acctbal > 0; SELECT c_custkey FROM customer", "SELECT c_custkey, c_mktsegment FROM customer"),
    (4, "SELECT {s_suppkey, s_name} FROM supplier WHERE s_acctbal > 0", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal <= 0"),
    (5, "SELECT r_title FROM region; SELECT FROM region", "SELECT r_name FROM region"),
    (6, "SELECT p_name FROM part", "SELECT p_title FROM part"),
]


def r15(spark: SparkSession, d: str) -> DataFrame:
    """Every alternative of every case run and compared, the best of them told per case."""
    for name in ("nation", "orders", "customer", "supplier", "region", "part"):
        table(spark, d, name).createOrReplaceTempView(name)
    cases = spark.createDataFrame(ALTERNATIVE_STATEMENTS, "case_id bigint, query string, gen string")
    cases = cases.withColumns({"question": F.lit("List them"), "query_category": F.lit("default")})
    return running.evaluate(spark, cases).select("case_id", (F.col("exact_match") == 1).alias("exact"), (F.col("correct") == 1).alias("correct"), (F.col("error_db_exec") == 1).alias("failed"))


# Statements over the given tables: same, reordered, extra column, wrong filter, failing.
STATEMENTS = [
    (1, "SELECT count(*) AS n FROM customer", "SELECT count(c_custkey) AS total FROM customer"),
    (
        2,
        "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
    ),
    (
        3,
        "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey",
        "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name DESC",
    ),
    (4, "SELECT p_name FROM part WHERE p_size > 10", "SELECT p_name FROM part WHERE p_size >= 11 AND p_retailprice > 0"),
    (5, "SELECT n_name FROM nation", "SELECT n_title FROM nation"),
    (6, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48"),
]


def run_statements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    for name in ("customer", "orders", "part", "nation", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(name)
    return running.run_cases(spark, spark.createDataFrame(STATEMENTS, "case_id bigint, gold string, gen string"))


def r16(spark: SparkSession, d: str) -> DataFrame:
    results, shapes, errors = run_statements(spark, d)
    sizes = results.groupBy("case_id", "side").agg(F.count("*").alias("n_rows"), F.max("pos").alias("last_pos"))
    found = shapes.select("case_id", "side", F.size("columns").cast("bigint").alias("n_columns"))
    done = found.join(sizes, ["case_id", "side"], "left").withColumn("failed", F.lit(False))
    failed = errors.select("case_id", "side").withColumn("failed", F.lit(True))
    return done.unionByName(failed, allowMissingColumns=True)


def r17(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: one verdict per case, all cases in one job.

    The results are written once, as running cases does it; every test then scans them
    instead of repeating the statements behind them.
    """
    return compare.verdicts(*nation_results(spark, d, land=True)).drop("exec_error_msg")


QUERIES = {
    "R1_distinct_rows": r1, "R2_sorted_columns": r2, "R3_dedup_names": r3, "R4_order_sensitive": r4,
    "R5_order_keys": r5, "R6_round": r6, "R7_row_order_equal": r7, "R8_set_equal": r8, "R9_multiset_diff": r9,
    "R10_sequence_equal": r10, "R11_column_match": r11, "R12_subset_match": r12, "R13_split_alternatives": r13,
    "R14_expand_braces": r14, "R15_any_gold": r15, "R16_run_cases": r16, "R17_case_verdict": r17,
}

_NATION = f"WITH gold AS ({_PLACED['gold']}), gen AS ({_PLACED['gen']})"

_VERDICT = f"""{_NATION},
ordered AS (
  SELECT coalesce(g.case_id, n.case_id) AS case_id,
         bool_and(g.k IS NOT NULL AND n.k IS NOT NULL AND g.k IS NOT DISTINCT FROM n.k AND g.v IS NOT DISTINCT FROM n.v)
         AND coalesce(g.case_id, n.case_id) % 5 <> 2 AS ordered_equal
  FROM gold g FULL JOIN gen n ON g.case_id = n.case_id AND g.pos = n.pos GROUP BY 1),
unequal AS (
  SELECT case_id FROM (SELECT case_id, k, v FROM gold EXCEPT SELECT case_id, k, v FROM gen) a
  UNION SELECT case_id FROM (SELECT case_id, k, v FROM gen EXCEPT SELECT case_id, k, v FROM gold) b),
columns AS (
  SELECT case_id, 'gold' AS side, 0 AS ordinal, list_sort(list(k)) AS vals FROM gold GROUP BY case_id
  UNION ALL SELECT case_id, 'gold', 1, list_sort(list(CAST(v AS VARCHAR))) FROM gold GROUP BY case_id
  UNION ALL SELECT case_id, 'gen', 0, list_sort(list(k)) FROM gen GROUP BY case_id
  UNION ALL SELECT case_id, 'gen', 1, list_sort(list(CAST(v AS VARCHAR))) FROM gen GROUP BY case_id
  UNION ALL SELECT case_id, 'gen', 2, list_sort(list(CAST(extra AS VARCHAR))) FROM gen WHERE case_id % 5 = 2 GROUP BY case_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id, side, vals ORDER BY ordinal) AS nth FROM columns),
matched AS (
  SELECT g.case_id, g.ordinal AS gold_ordinal, n.ordinal AS gen_ordinal
  FROM (SELECT * FROM numbered WHERE side = 'gold') g LEFT JOIN (SELECT * FROM numbered WHERE side = 'gen') n
    ON g.case_id = n.case_id AND g.vals = n.vals AND g.nth = n.nth),
subset AS (
  SELECT case_id, bool_and(gen_ordinal IS NOT NULL) AND case_id NOT IN (SELECT case_id FROM unequal) AS subset_match
  FROM matched GROUP BY case_id),
sequences AS (
  SELECT case_id, list(r ORDER BY p) AS seq, side FROM (
    SELECT case_id, 'gold' AS side, concat(k, '|', v) AS r, min(pos) AS p FROM gold GROUP BY 1, 2, 3
    UNION ALL SELECT case_id, 'gen', concat(k, '|', v), min(pos) FROM gen GROUP BY 1, 2, 3) x GROUP BY case_id, side)
"""

ORACLES = {
    "R1_distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "R2_sorted_columns": "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer",
    "R3_dedup_names": "SELECT o_orderkey, o_orderstatus AS k_1, o_orderpriority AS k_2 FROM orders",
    "R4_order_sensitive": r"""SELECT case_id, query_category = 'order_by'
        OR regexp_matches(question, '(?i)\b(order|sort|arrange)\b') AS order_sensitive FROM {questions} q""",
    "R5_order_keys": """SELECT case_id, key_no, key_name, ascending FROM {questions} q JOIN (VALUES
        (0, 1, 'value', false), (0, 2, 'user_id', true), (1, 1, 'value', true), (1, 2, 'ts', false),
        (2, 1, 'round(value, 2)', true)) k(template, key_no, key_name, ascending) ON case_id % 5 = template""",
    "R6_round": """SELECT l_orderkey, l_linenumber, round_even(l_discount, 1) AS l_discount,
        round_even(l_extendedprice, 1) AS l_extendedprice FROM lineitem""",
    "R7_row_order_equal": _VERDICT + "SELECT * FROM ordered",
    "R8_set_equal": """WITH gold AS (SELECT DISTINCT case_id, l_orderkey, l_quantity, l_returnflag FROM {gold_lines} a),
        gen AS (SELECT DISTINCT case_id, l_orderkey, l_quantity, l_returnflag FROM {gen_lines} b),
        odd AS (SELECT case_id FROM (SELECT * FROM gold EXCEPT SELECT * FROM gen) a
          UNION SELECT case_id FROM (SELECT * FROM gen EXCEPT SELECT * FROM gold) b)
        SELECT case_id, case_id NOT IN (SELECT case_id FROM odd) AS set_equal
        FROM (SELECT case_id FROM gold UNION SELECT case_id FROM gen) c""",
    "R9_multiset_diff": """SELECT case_id, concat_ws('|', l_orderkey, CAST(l_quantity AS BIGINT), l_returnflag) AS row,
          CAST(greatest(sum(s), 0) AS BIGINT) AS missing, CAST(greatest(-sum(s), 0) AS BIGINT) AS extra
        FROM (SELECT case_id, l_orderkey, l_quantity, l_returnflag, 1 AS s FROM {gold_lines} a
          UNION ALL SELECT case_id, l_orderkey, l_quantity, l_returnflag, -1 FROM {gen_lines} b) u
        GROUP BY case_id, l_orderkey, l_quantity, l_returnflag HAVING sum(s) <> 0""",
    "R10_sequence_equal": _VERDICT + """SELECT g.case_id, g.seq = n.seq AND g.case_id % 5 <> 2 AS sequence_equal
        FROM sequences g JOIN sequences n ON g.case_id = n.case_id AND g.side = 'gold' AND n.side = 'gen'""",
    "R11_column_match": _VERDICT + "SELECT * FROM matched",
    "R12_subset_match": _VERDICT + "SELECT * FROM subset",
    "R13_split_alternatives": """SELECT case_id, CAST(alternative - 1 AS INT) AS alternative, alternative_sql FROM (
        SELECT case_id, unnest(parts) AS alternative_sql, generate_subscripts(parts, 1) AS alternative FROM (
          SELECT case_id, list_filter(list_transform(string_split(query, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts
          FROM {alternative_cases} a) p) u""",
    "R14_expand_braces": r"""WITH alternatives AS (
          SELECT case_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS alternative FROM (
            SELECT case_id, list_filter(list_transform(string_split(query, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts
            FROM {alternative_cases} a) p),
        named AS (SELECT *, list_transform(string_split(regexp_extract(text, '\{([^}]*)\}', 1), ','), lambda x: trim(x)) AS names,
            instr(text, '{') AS a, instr(text, '}') AS b FROM alternatives),
        masks AS (SELECT *, unnest(generate_series(1, CAST(2 ** len(names) AS BIGINT) - 1)) AS mask FROM named),
        picks AS (SELECT *, list_filter(range(0, len(names)), lambda i: (mask >> CAST(i AS BIGINT)) & 1 = 1) AS bits FROM masks),
        texts AS (SELECT *, array_to_string(list_transform(bits, lambda i: names[i + 1]), ', ') AS chosen FROM picks)
        SELECT case_id, CAST(alternative AS INT) AS alternative,
          CAST(row_number() OVER (PARTITION BY case_id, alternative ORDER BY len(bits), bits) - 1 AS INT) AS variant,
          CASE WHEN a = 0 THEN text ELSE concat(substr(text, 1, a - 1), chosen,
            replace(substr(text, b + 1), 'GROUP BY {}', concat('GROUP BY ', chosen))) END AS variant_sql FROM texts""",
    "R15_any_gold": """WITH verdict AS (
          SELECT 1 AS case_id, (SELECT count(*) FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1
              EXCEPT SELECT n_regionkey, count(*) FROM nation GROUP BY 1) x) = 0 AS exact, true AS correct, false AS failed
          UNION ALL SELECT 2, (SELECT count(*) FROM (SELECT o_orderpriority, max(o_totalprice) FROM orders GROUP BY 1
              EXCEPT SELECT o_orderpriority, max(o_totalprice) FROM orders GROUP BY 1) x) = 0, true, false
          UNION ALL SELECT 3, false, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT
              SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment FROM customer) y) x) = 0, false
          UNION ALL SELECT 4, same, same, false FROM (SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) = 0
              AND (SELECT count(*) FROM supplier WHERE s_acctbal <= 0) = 0 AS same) z
          UNION ALL SELECT 5, false, false, true UNION ALL SELECT 6, false, false, true)
        SELECT CAST(case_id AS BIGINT) AS case_id, exact, correct, failed FROM verdict""",
    "R16_run_cases": "\nUNION ALL ".join(
        f"SELECT CAST({case} AS BIGINT) AS case_id, '{side}' AS side, n_rows, n_rows - 1 AS last_pos, "
        f"CAST({width} AS BIGINT) AS n_columns, false AS failed FROM (SELECT count(*) AS n_rows FROM ({sql}) q) c"
        for case, gold, gen in STATEMENTS
        for side, sql in (("gold", gold), ("gen", gen))
        if "n_title" not in sql
        for width in [{1: 1, 2: 3 if side == "gen" else 2, 3: 2, 4: 1, 5: 1, 6: 2}[case]]
    ) + "\nUNION ALL SELECT CAST(5 AS BIGINT), 'gen', NULL, NULL, NULL, true",
    "R17_case_verdict": _VERDICT + """SELECT o.case_id,
        CAST(ordered_equal OR (o.case_id % 5 <> 2 AND o.case_id NOT IN (SELECT case_id FROM unequal)) AS INT) AS exact_match,
        CAST(ordered_equal OR (o.case_id % 5 <> 2 AND o.case_id NOT IN (SELECT case_id FROM unequal)) OR subset_match AS INT) AS correct,
        0 AS error_db_exec FROM ordered o JOIN subset s ON o.case_id = s.case_id""",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
