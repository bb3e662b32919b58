"""Run the statements of many cases and bring cases from their text to verdicts and a summary.

The driver draws cases one after the other and only submits their statements, a few at a time; rows go
from the executors to the shared folder. There is one folder per statement that runs at the same time,
however many cases there are, and a statement's rows count once its commit row is written.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from queue import SimpleQueue

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlassay.functions import sqltext
from sqlassay.operators import compare, summary
from sqlassay.session import fresh_path, landed
from sqlassay.sources.tables import load_table

COMMIT_SCHEMA = "case_id bigint, side string, token string, columns array<string>, exec_error_msg string"
ROW_SCHEMA = compare.LONG_SCHEMA + ", token string"
#: Commit rows the driver holds before it writes them down.
COMMITS = 1000
SIDES = {"gold": "Gold", "gen": "Generated"}


@dataclass(frozen=True)
class SharedTable:
    """A table that was written down once, for every case that names its file."""

    name: str
    path: str
    schema: T.StructType


def shared_tables(spark: SparkSession, paths: Iterable[str], multi_line: bool = False) -> dict[str, SharedTable]:
    """The CSV files of all cases by path, each loaded and written down once."""
    found = {}
    for path in dict.fromkeys(paths):
        name, table = load_table(spark, path, multi_line)
        found[path] = SharedTable(name, fresh_path(spark, name), table.schema)
        table.write.parquet(found[path].path)
    return found


def _own_session(spark: SparkSession, files: list[str] | None, tables: dict[str, SharedTable]) -> SparkSession:
    """A child session that sees the case's files as views, and nothing else; a case without files runs in ``spark``."""
    if files is None:
        return spark
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            child.conf.set(key, value)
    seen = set()
    for file in files:
        shared = tables.get(file)
        if shared is None:
            raise FileNotFoundError(file)
        if shared.name.lower() in seen:
            raise ValueError(f"two files of one case are called {shared.name}")
        seen.add(shared.name.lower())
        child.read.schema(shared.schema).parquet(shared.path).createOrReplaceTempView(shared.name)
    return child


def _cut_off(context: SparkContext, group: str, timeout: float, done: threading.Event) -> None:
    """Cancel a group's jobs ``timeout`` seconds after its first task began."""
    tracker = context.statusTracker()
    began = None
    while not done.wait(0.05):
        if began is None:
            jobs = filter(None, map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)))
            stages = filter(None, (tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds))
            if any(stage.numActiveTasks or stage.numCompletedTasks for stage in stages):
                began = time.monotonic()
        elif time.monotonic() - began > timeout:
            context.cancelJobGroup(group)
            return


def _reason(error: Exception) -> str:
    if isinstance(error, PySparkException):
        return error.getCondition() or type(error).__name__
    # What this module raises itself says which file is meant.
    return f"{type(error).__name__}: {error}" if isinstance(error, (FileNotFoundError, ValueError)) else type(error).__name__


def run_cases(
    spark: SparkSession,
    cases: DataFrame,
    tables: dict[str, SharedTable] | None = None,
    decimals: int | None = None,
    at_once: int = 8,
    timeout: float | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the statements of ``cases`` (case_id, gold, gen and, if wanted, files): (long results, shapes, errors).

    A side whose statement is null is not run. With ``files``, paths that ``tables`` knows, a case sees these tables
    only and in a session of its own, so names of other cases neither help nor collide; without the column
    or with a null there it runs against the current views. A statement that fails, or
    runs longer than ``timeout`` seconds from its first task on, is an error record; waiting for
    free slots does not count. In a session with fair scheduling a slow statement does not hold up the others.
    """
    path = fresh_path(spark, "results")
    context = spark.sparkContext
    slots: SimpleQueue[int] = SimpleQueue()
    for slot in range(at_once):
        slots.put(slot)
        # Every folder exists from the start, so that reading them needs no list of what ran.
        spark.createDataFrame([], ROW_SCHEMA).write.parquet(f"{path}/rows/slot={slot}")
    spark.createDataFrame([], COMMIT_SCHEMA).write.parquet(f"{path}/commits")

    def land(case: Row, side: str) -> tuple:
        token = uuid.uuid4().hex
        context.setJobGroup(token, f"case {case['case_id']} {side}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", token)
        done = threading.Event()
        if timeout:
            threading.Thread(target=_cut_off, args=(context, token, timeout, done), daemon=True).start()
        slot = slots.get()
        try:
            own = _own_session(spark, case["files"], tables or {})
            df = compare.dedup_names(own.sql(case[side]))
            place = F.monotonically_increasing_id()  # follows the order the statement asked for
            rows = compare.to_long(df, F.lit(case["case_id"]), side, place, df.columns, case[f"{side}_keys"], decimals)
            rows.withColumn("token", F.lit(token)).write.mode("append").parquet(f"{path}/rows/slot={slot}")
            return case["case_id"], side, token, df.columns, None
        except Exception as error:  # noqa: BLE001 - whatever the statement raised becomes its record
            return case["case_id"], side, None, None, f"{SIDES[side]} query failed to execute: {_reason(error)}"
        finally:
            slots.put(slot)
            done.set()

    held: list[tuple] = []

    def commit(finished: set[Future], least: int) -> None:
        held.extend(f.result() for f in finished)
        if len(held) >= least:
            spark.createDataFrame(held, COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")
            held.clear()

    with ThreadPoolExecutor(at_once) as pool:
        running: set[Future] = set()
        for case, side in _statements(cases):
            if len(running) >= 2 * at_once:
                finished, running = wait(running, return_when=FIRST_COMPLETED)
                commit(finished, COMMITS)
            running.add(pool.submit(land, case, side))
        commit(wait(running).done, 1)

    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")
    rows = spark.read.schema(ROW_SCHEMA).parquet(*[f"{path}/rows/slot={slot}" for slot in range(at_once)])
    # Rows of a statement that did not finish have no commit row.
    rows = rows.join(commits.filter("token IS NOT NULL").select("token"), "token", "left_semi").drop("token")
    done = commits.filter("exec_error_msg IS NULL").select("case_id", "side", "columns")
    errors = commits.filter("exec_error_msg IS NOT NULL").select("case_id", "side", "exec_error_msg")
    return dense_positions(rows), done, errors


def _statements(cases: DataFrame) -> Iterator[tuple[Row, str]]:
    """The statements to run, drawn a partition at a time."""
    files = F.col("files").cast("array<string>") if "files" in cases.columns else F.lit(None).cast("array<string>")
    keys = [F.coalesce(F.transform(sqltext.order_items(F.col(side)), sqltext.order_item_name), F.array().cast("array<string>")).alias(f"{side}_keys") for side in SIDES]
    for case in cases.select(F.col("case_id").cast("bigint").alias("case_id"), *SIDES, files.alias("files"), *keys).toLocalIterator():
        for side in SIDES:
            if case[side] is not None:
                yield case, side


def dense_positions(results: DataFrame) -> DataFrame:
    """Replace order-preserving ids by 0, 1, 2, ... per (case, side).

    An id is (partition << 33) + row, so a row's position is its row number plus the
    sizes of the partitions before it: a window over one row per partition, not per row.
    """
    part = F.shiftright("pos", 33)
    sizes = results.groupBy("case_id", "side", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("case_id", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("case_id", "side", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    row = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        results.withColumn("part", part)
        .join(offsets, ["case_id", "side", "part"])
        .withColumn("pos", row + F.col("offset"))
        .drop("part", "offset")
    )


def run_alternatives(spark: SparkSession, cases: DataFrame, most: int = compare.BRACE_COLUMNS, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Run cases (case_id, query, gen) whose gold text holds alternatives and braces: (variants, results, shapes, errors).

    Each gold variant runs once and each generated statement once; ``variants`` maps variant_id to case_id, alternative,
    variant and its text, and the other three have the variant's id as their case_id. A text whose braces hold
    more than ``most`` columns is an error record of its case. Further columns of ``cases`` are passed on in ``variants``.
    """
    split = compare.alternatives(cases)
    variants = compare.expand_braces(split, most=most).unionByName(compare.too_wide(split, most=most), allowMissingColumns=True)
    variants = variants.join(cases.drop("query"), "case_id").withColumn("variant_id", F.monotonically_increasing_id())
    variants = landed(variants, "variants")
    whole = variants.filter("variant_sql IS NOT NULL")
    files = [c for c in ("files",) if c in cases.columns]
    gold = whole.select(F.col("variant_id").alias("case_id"), F.col("variant_sql").alias("gold"), F.lit(None).cast("string").alias("gen"), *files)
    # Generated statements are told from gold ones by ids below zero.
    own_id = -1 - F.col("case_id")
    gen = cases.join(whole.select("case_id").distinct(), "case_id", "left_semi").select(own_id.alias("case_id"), F.lit(None).cast("string").alias("gold"), "gen", *files)
    results, shapes, errors = run_cases(spark, gold.unionByName(gen), **options)
    ids = whole.select(own_id.alias("gen_id"), "variant_id")

    def per_variant(rows: DataFrame) -> DataFrame:
        """Rows of generated statements once per variant of their case."""
        names = [c for c in rows.columns if c != "case_id"]
        shared = rows.filter("side = 'gen'").join(ids, F.col("case_id") == F.col("gen_id")).select(F.col("variant_id").alias("case_id"), *names)
        return rows.filter("side = 'gold'").unionByName(shared)

    unread = variants.filter("variant_sql IS NULL").select(F.col("variant_id").alias("case_id"), F.lit("gold").alias("side"), F.col("exec_error_msg"))
    return variants, per_variant(results), per_variant(shapes), per_variant(errors).unionByName(unread)


def evaluate(spark: SparkSession, cases: DataFrame, **options) -> DataFrame:
    """One row per case (case_id, question, query_category, query, gen): exact, correct, error flag and message.

    A case is exact if one of its gold variants is, correct if one is exact or contained. It failed
    if its generated statement did, or if no gold variant could be run.
    """
    variants, results, shapes, errors = run_alternatives(spark, cases, **options)
    asked = variants.select(F.col("variant_id").alias("case_id"), "question", "query_category")
    told = compare.verdicts(asked, landed(results, "results"), shapes, errors)
    told = landed(told.withColumnRenamed("case_id", "variant_id").join(variants.select("variant_id", "case_id"), "variant_id"), "variant_verdicts")
    failed = told.groupBy("case_id").agg(
        F.bool_and(F.col("error_db_exec") == 1).cast("int").alias("error_db_exec"),
        F.when(F.bool_and(F.col("error_db_exec") == 1), F.min_by("exec_error_msg", "variant_id")).otherwise("").alias("exec_error_msg"),
    )
    any_of = compare.any_gold(told).select("case_id", F.col("exact").cast("int").alias("exact_match"), F.col("correct").cast("int").alias("correct"))
    # A case whose gold text is blank has no variant; there is nothing it could agree with.
    blank = {"exact_match": 0, "correct": 0, "error_db_exec": 1, "exec_error_msg": "Gold query failed to execute: no statement"}
    return cases.select("case_id").join(any_of, "case_id", "left").join(failed, "case_id", "left").fillna(blank)


def benchmark(spark: SparkSession, cases: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """A whole run: (one row per case with its verdict, one summary row per run).

    ``cases`` as for ``evaluate``, with any of run_id, generation_error_msg, latency_seconds and input_tokens; a case with a generation error, or without a
    generated statement, is not run.
    """
    defaults = {"run_id": F.lit("run"), "generation_error_msg": F.lit(""), "latency_seconds": F.lit(0.0)}
    for name, value in defaults.items():
        cases = cases.withColumn(name, F.coalesce(name, value) if name in cases.columns else value)
    silent = (F.trim(F.coalesce("gen", F.lit(""))) == "") & (F.col("generation_error_msg") == "")
    cases = landed(cases.withColumn("generation_error_msg", F.when(silent, "no statement was generated").otherwise(F.col("generation_error_msg"))), "cases")
    told = evaluate(spark, cases.filter("generation_error_msg = ''"), **options)
    rows = cases.join(told, "case_id", "left").fillna({"exact_match": 0, "correct": 0, "error_db_exec": 0, "exec_error_msg": ""})
    rows = landed(summary.outcome(rows), "case_rows")
    return rows, summary.run_rates(summary.run_counts(rows, "run_id"))
