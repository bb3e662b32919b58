"""Timestamps as plain microseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column.

    A TIMESTAMP_NTZ goes through its calendar fields, which need no zone.
    """
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        seconds = F.expr(f"extract(SECOND FROM `{name}`)") * F.lit(SECOND)
        return (
            days * F.lit(DAY)
            + F.hour(col).cast("bigint") * F.lit(HOUR)
            + F.minute(col).cast("bigint") * F.lit(60 * SECOND)
            + seconds.cast("bigint")
        )
    return F.unix_micros(col.cast("timestamp"))
