"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Items are placed largest first. A bin carries what is left in it, a bitmap of the sources
and a bitmap of the duplicate clusters it holds; an item fits a bin that has room and neither
its source nor its cluster. Bins are kept by residual; a bit per residual tells which ones
exist, so the next residual that is large enough is found by a shift, and the search goes
on to the next until the tightest compatible bin is found. A new bin is opened only when
no bin fits.

A text longer than the capacity is cut into pieces, of which all but the last fill a bin
each. Items are dealt over shards at random, so a hot source or cluster is spread evenly, and
each shard of about ``SHARD`` small rows is packed alone; the number of shards follows from
the number of items. Texts do not move, only their lengths.

Defined cases: a null or empty text is one piece of length 0, which takes a place (and may
conflict) but no room; a null source or cluster conflicts with nothing; repeated rows are
items of their own, in one cluster and so in different bins; ties in length are placed by
doc_id (nulls last), then piece; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.session import landed

CAPACITY = 2048
SHARD = 2048


def best_fit(lengths: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the order given; None as a source or cluster conflicts with nothing."""
    source_bit = {name: 1 << k for k, name in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {name: 1 << k for k, name in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    by_residual: dict[int, dict[int, list[int]]] = {}  # residual -> sources of the bins -> bins
    residuals = 0  # bit r is set when a bin has r left
    left: list[int] = []
    held: list[int] = []
    placed = []

    def tightest(length: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        rest = residuals >> length
        residual = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            for present, bins in by_residual[residual].items():
                if not present & source:
                    for at, number in enumerate(bins):
                        if not held[number] & cluster:
                            return residual, present, at
            rest >>= step + 1
            residual += 1
        return None

    for length, source_name, cluster_name in zip(lengths, sources, clusters):
        source, cluster = source_bit.get(source_name, 0), cluster_bit.get(cluster_name, 0)
        found = tightest(length, source, cluster)
        if found:
            residual, present, at = found
            group = by_residual[residual][present]
            number = group[at]
            group[at] = group[-1]
            group.pop()
            if not group:
                del by_residual[residual][present]
                if not by_residual[residual]:
                    residuals &= ~(1 << residual)
        else:
            number, residual, present = len(left), capacity, 0
            left.append(capacity)
            held.append(0)
        placed.append((number, capacity - residual))
        left[number] = residual - length
        held[number] |= cluster
        by_residual.setdefault(left[number], {}).setdefault(present | source, []).append(number)
        residuals |= 1 << left[number]
    return placed


def items(docs: DataFrame, capacity: int, length: Column, source: Column, cluster: Column) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, source, cluster."""
    rows = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("bigint").alias("n"), source.cast("string").alias("source"), cluster.alias("cluster"))
    last = F.greatest(F.expr(f"(n + {capacity - 1}) div {capacity}"), F.lit(1)) - 1
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - start).alias("length"), "source", "cluster")


def words(text: str = "text") -> Column:
    """The length used unless another is given: words between white space."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def copies(text: str = "text") -> Column:
    """The cluster used unless another is given: texts that are equal but for white space and case."""
    return F.md5(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))))


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, source: Column | None = None, cluster: Column | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_offset."""
    length = words() if length is None else length
    rows = items(docs, capacity, length, F.col("source") if source is None else source, copies() if cluster is None else cluster)
    rows = landed(rows.withColumn("item", F.monotonically_increasing_id()), "packing_items")
    shards = max(1, -(-rows.count() // shard))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "item"], ascending=[False, True, True, True], na_position="last", kind="stable")
        known = lambda name: [None if pd.isna(x) else x for x in frame[name]]
        placed = best_fit(frame["length"].tolist(), known("source"), known("cluster"), capacity)
        frame["bin_id"] = [(int(frame["shard"].iloc[0]) << 32) + number for number, _ in placed]
        frame["bin_offset"] = [offset for _, offset in placed]
        return frame[["doc_id", "piece", "start", "length", "bin_id", "bin_offset"]].astype({"doc_id": "Int64"} if kind in ("int", "bigint") else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    schema = f"doc_id {kind}, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint"
    return dealt.groupBy("shard").applyInPandas(packed, schema)


def bins(packed: DataFrame) -> DataFrame:
    """bin_id, pieces and filled tokens of each bin."""
    return packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("filled"))
