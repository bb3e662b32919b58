"""Small helpers that keep costly expressions from being evaluated twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: Sequence[str], array: str | Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element; empty arrays and null elements give none.

    A plain explode makes the optimizer add ``size(array) > 0`` below it, which computes
    the array's whole expression a second time. The outer form with a filter does not.
    """
    generated = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, generated).filter(F.col(name).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
