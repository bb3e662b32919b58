"""Eval cases and the data files they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.functions.rows import exploded

REQUIRED = ["question", "query", "data_csv_files"]
OPTIONAL = {
    "query_category": "default",
    "instructions": "",
    "glossary": "",
    "k_shot_prompt": "",
    "prev_invalid_sql": "",
    "prev_error_msg": "",
}


def load_cases(spark: SparkSession, path: str, n: int | None = None, key: str | None = None) -> DataFrame:
    """Eval cases of a CSV file, every value a text and never null.

    The header says which columns are there; a line that does not fit it keeps its text in
    ``_corrupt_record``. Fields may span lines, so a file is one task: give a folder of many
    files where there are many cases. ``n`` takes the first cases in the order of ``key``, or, where
    no key column is named, of the files' names and the cases' places in them.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    names = reader.csv(path).columns
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"Missing required columns in {path}: {', '.join(missing)}")
    schema = ", ".join([*(f"`{c}` string" for c in names), "_corrupt_record string"])
    cases = reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    if n is not None and not key:
        # A file is read by one task in its own order, which the id follows.
        cases = cases.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__place"))
    cases = cases.na.fill("", subset=names)
    cases = cases.withColumns({c: F.lit(v) for c, v in OPTIONAL.items() if c not in names})
    if n is not None:
        cases = cases.orderBy(key, "question", "query") if key else cases.orderBy("__file", "__place")
        cases = cases.limit(n).drop("__file", "__place")
    return cases


def case_files(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per (case, file), with ``exists`` where the existing ``files`` are given."""
    names = F.filter(F.transform(F.split("data_csv_files", ","), lambda f: F.trim(f)), lambda f: f != "")
    rows = exploded(cases, ["case_id"], names, "file", "file_no")
    if files is None:
        return rows
    known = files.select("file", F.lit(True).alias("exists")).distinct()
    return rows.join(known, "file", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
