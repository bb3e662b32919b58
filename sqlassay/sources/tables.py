"""Named files as tables, and what their schemas say."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def clean_name(name: str) -> str:
    """A name that needs no quotes: letters, digits and ``_`` only, not empty and not beginning with a digit."""
    clean = re.sub(r"\W", "_", name)
    if not clean.strip("_"):
        raise ValueError(f"no letter or digit in the name {name!r}")
    return f"_{clean}" if clean[0].isdigit() else clean


def load_table(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[str, DataFrame]:
    """A CSV file as (table name, table), both names and columns cleaned; quotes inside values are doubled.

    Values with line ends need ``multi_line``, which reads a file in one task; a folder of files is still read in parallel.
    """
    name = clean_name(os.path.splitext(os.path.basename(path.rstrip("/")))[0])
    raw = spark.read.csv(path, header=True, inferSchema=True, multiLine=multi_line, escape='"')
    columns = [clean_name(c) for c in raw.columns]
    if len(set(columns)) < len(columns):
        raise ValueError(f"columns of {path} clean to the same name: {columns}")
    return name, raw.toDF(*columns)


def load_tables(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> dict[str, DataFrame]:
    """CSV files as tables and temp views named after the file.

    A missing or broken file is skipped with a warning. Two names that clean to the same
    text are an error: one would silently hide the other.
    """
    tables: dict[str, DataFrame] = {}
    for path in paths:
        name = clean_name(os.path.splitext(os.path.basename(path.rstrip("/")))[0])
        if name in tables:
            raise ValueError(f"{path} cleans to a table name already taken: {name}")
        try:
            _, tables[name] = load_table(spark, path, multi_line)
        except PySparkException as error:
            log.warning("skipping %s: %s", path, error.getCondition())
            continue
        tables[name].createOrReplaceTempView(f"`{name}`" if not re.match(r"^\w+$", name) else name)
    return tables


def type_class(dtype: T.DataType) -> str:
    """INTEGER, REAL or TEXT; dates count as text."""
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, T.NumericType):
        return "REAL"
    return "TEXT"


CATALOG_SCHEMA = "schema_id bigint, table_name string, ordinal int, column_name string, type_class string"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as an inline table, whose size the planner knows."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    casts = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in fields)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


def infer_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of each table, from the full Spark schema; no data is read."""
    rows = [
        (name, i, field.name, type_class(field.dataType))
        for name, df in tables.items()
        for i, field in enumerate(df.schema)
    ]
    spark = next(iter(tables.values())).sparkSession
    return small_table(spark, rows, "table_name string, ordinal int, column_name string, type_class string")
