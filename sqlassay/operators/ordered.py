"""Ordered work per key that does not need a whole key in one task.

A window partitioned by key alone puts every row of a busy key into one task. Here the
rows of a key are cut into chunks by a deterministic expression (a day, a range of
positions). Windows run per (key, chunk); only one summary row per chunk meets its
neighbours in a window per key, and the result joins back on (key, chunk). All steps are
functions of the row values, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlassay.functions.times import DAY, HOUR, SECOND

CHUNK = "__chunk"
ALWAYS, NEVER = -(2**62), 2**62
WIDEST = 3650 * DAY


def _chunk_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK)


def measured_span(df: DataFrame, keys: Sequence[str], at: Column, target: int = 1_000_000) -> int:
    """Chunk width in microseconds that keeps every key below ``target`` rows per chunk.

    One number comes back to the driver: the rows of the busiest hour of any key. Sparse
    keys get wide chunks, so that most of them are a single one.
    """
    hours = df.select(*keys, F.floor(at / F.lit(HOUR)).alias("__hour")).groupBy(*keys, "__hour").count()
    busiest = hours.agg(F.max("count")).first()[0] or 1
    return min(max(SECOND, HOUR * target // busiest), WIDEST)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: the values of the preceding row of the key as a struct, null at the start."""
    rows = df.withColumn(CHUNK, chunk)
    value = F.struct(*values)
    last = rows.groupBy(*keys, CHUNK).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, CHUNK, F.lag("__last").over(_chunk_window(keys)).alias("__carried"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (
        rows.withColumn(name, F.lag(value).over(inside))
        .join(carried, [*keys, CHUNK], "left")
        .withColumn(name, F.coalesce(name, "__carried"))
        .drop(CHUNK, "__carried")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: dict[str, Column]
) -> DataFrame:
    """Add one running total per entry of ``sums``, the current row included."""
    rows = df.withColumn(CHUNK, chunk)
    for name, value in sums.items():
        rows = rows.withColumn(name, value)
    before = _chunk_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, CHUNK).agg(*[F.sum(n).alias(f"__total_{n}") for n in sums])
    offsets = totals.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__offset_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        rows = rows.withColumn(name, F.sum(name).over(inside))
    rows = rows.join(offsets, [*keys, CHUNK], "left")
    for name in sums:
        rows = rows.withColumn(name, F.col(name) + F.col(f"__offset_{name}"))
    return rows.drop(CHUNK, *[f"__offset_{n}" for n in sums])


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new key begins in sorted rows."""
    changed = np.zeros(table.num_rows, dtype=bool)
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    changed[0] = True
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Regroup sorted Arrow batches so that no yielded table ends inside a group."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cut = int(_starts(table, keys)[-1])
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = [table.slice(cut)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _spans(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[int, int]]:
    starts = _starts(table, keys).tolist()
    return zip(starts, [*starts[1:], table.num_rows])


def _next_allowed(at: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """For each row the first later row at least ``gap`` after it; the row count if none."""
    return np.maximum(np.searchsorted(at, at + gap, side="left"), np.arange(1, len(at) + 1))


def _chunk_steps(keys: Sequence[str]):
    """How a chunk turns "earliest time allowed" on entry into the one on exit.

    Accepted rows form chains (row, first row far enough after it, ...). Chains from
    different starts soon merge, so the exit as a function of the entry is a short step
    function: ``until[i]`` bounds the entry times that leave with ``exits[i]``. An entry
    later than the last bound passes through unchanged. A reset row starts a chain
    whatever the entry was, so only the part after the last one counts.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            times, gaps = table["__at"].to_numpy(), table["__gap"].to_numpy()
            flags = table["__reset"].to_numpy()
            firsts, untils, exit_lists = [], [], []
            for lo, hi in _spans(table, keys):
                resets = np.flatnonzero(flags[lo:hi])
                first = lo + (int(resets[-1]) if len(resets) else 0)
                at, gap = times[first:hi], gaps[first:hi]
                nxt = _next_allowed(at, gap)
                last = np.where(nxt < len(at), nxt, np.arange(len(at)))
                while not np.array_equal(further := last[last], last):
                    last = further
                exits = at[last] + gap[last]
                if len(resets):
                    until, exits = [NEVER], exits[:1]
                else:
                    final = np.append(exits[1:] != exits[:-1], True)
                    until, exits = at[final].tolist(), exits[final]
                firsts.append(lo)
                untils.append(until)
                exit_lists.append(exits.tolist())
            heads = table.select(list(keys)).take(firsts)
            longs = pa.list_(pa.int64())
            heads = heads.append_column("__until", pa.array(untils, longs))
            yield from heads.append_column("__exits", pa.array(exit_lists, longs)).to_batches()

    return steps


def _entries(keys: Sequence[str]):
    """Walk the chunks of each key in order and give every chunk its entry time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, allowed = None, ALWAYS
        for batch in batches:
            heads = zip(*[batch[k].to_pylist() for k in keys])
            entry = []
            for head, until, exits in zip(heads, batch["__until"].to_pylist(), batch["__exits"].to_pylist()):
                if head != current:
                    current, allowed = head, ALWAYS
                entry.append(allowed)
                step = bisect_left(until, allowed)
                if step < len(exits):
                    allowed = exits[step]
            table = pa.Table.from_batches([batch]).drop_columns(["__until", "__exits"])
            yield from table.append_column("__entry", pa.array(entry, pa.int64())).to_batches()

    return walk


def _accept(keys: Sequence[str], helpers: Sequence[str], name: str):
    """Mark the accepted rows of each chunk; its first row is the one that holds the entry time."""

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            times, gaps = table["__at"].to_numpy(), table["__gap"].to_numpy()
            flags, entries = table["__reset"].to_numpy(), table["__entry"].to_numpy()
            taken = np.zeros(table.num_rows, dtype=bool)
            data = np.ones(table.num_rows, dtype=bool)
            for lo, hi in _spans(table, keys):
                data[lo] = False
                lo, allowed = lo + 1, int(entries[lo])
                at = times[lo:hi]
                nxt = _next_allowed(at, gaps[lo:hi]).tolist()
                row = int(np.searchsorted(at, allowed, side="left"))
                for reset in [*np.flatnonzero(flags[lo:hi]).tolist(), hi - lo]:
                    while row < reset:
                        taken[lo + row] = True
                        row = nxt[row]
                    row = reset
            table = table.drop_columns(list(helpers)).append_column(name, pa.array(taken))
            yield from table.filter(pa.array(data)).to_batches()

    return accept


def spaced(
    df: DataFrame,
    keys: Sequence[str],
    at: Column,
    tie: str,
    gap: Column,
    name: str,
    reset: Column | None = None,
    span: int = DAY,
) -> DataFrame:
    """Add ``name``: true where a row is at least ``gap`` of the last accepted row after it.

    Greedy and sequential by nature: which row counts depends on the last one that did.
    Each chunk of ``span`` microseconds is first reduced to its step function, the short
    functions are chained per key, and every chunk is then marked on its own.
    ``reset`` rows are always accepted. ``at`` and ``gap`` are in microseconds. A span of
    many gaps gives the chains time to merge and keeps the step functions short.
    """
    group = [*keys, CHUNK]
    helpers = ["__at", "__gap", "__reset", "__entry", CHUNK]
    rows = (
        df.withColumn("__at", at.cast("bigint"))
        .withColumn("__gap", gap.cast("bigint"))
        .withColumn("__reset", F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False))
        .withColumn(CHUNK, F.floor(F.col("__at") / F.lit(span)).cast("bigint"))
    )
    heads = [rows.schema[k] for k in group]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("__until", "__exits")]
    steps = (
        rows.select(*group, "__at", "__gap", "__reset", tie)
        .repartition(*[F.col(k) for k in group])
        .sortWithinPartitions(*group, "__at", tie)
        .mapInArrow(_chunk_steps(group), T.StructType([*heads, *lists]))
    )
    entries = (
        steps.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*group)
        .mapInArrow(_entries(keys), T.StructType([*heads, T.StructField("__entry", T.LongType())]))
        .withColumns({"__at": F.lit(ALWAYS), "__gap": F.lit(0).cast("bigint"), "__reset": F.lit(False)})
    )
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return (
        rows.unionByName(entries, allowMissingColumns=True)
        .repartition(*[F.col(k) for k in group])
        .sortWithinPartitions(*group, "__at", tie)
        .mapInArrow(_accept(group, helpers, name), schema)
    )
