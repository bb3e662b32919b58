"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. Equal blocks get one
integer, different blocks get different ones; then adjacent pairs of integers are named the
same way, level by level, until one integer is left per text. Two texts are equal exactly
when they have as many blocks and the same last integer: no digest decides.

How integers are given without one global window: blocks are sorted by (64-bit digest,
content). A grouped aggregate collects the *different* contents of each digest (one, but for
a clash), so a block that a third of all texts share leaves each map task once. The narrow
list of (digest, place among its contents) is then range-sorted and numbered, and the
numbering is written to the shared folder, so a lost executor cannot change it. Only a
digest that really clashes makes the contents travel again.

Defined cases: a null text counts as empty; an empty text is one empty block; rows that
repeat a whole (doc_id, text) are named once and given back as often as they occur, each counted in ``group_size``; a null
doc_id is a document like any other, but never the one that stays unless all its copies
have none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions.rows import exploded
from sqlassay.session import landed

BLOCK = 4096
_KEY = ["doc_id", "sha"]
_PORTION = 4096


def named(rows: DataFrame, content: str, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``rows`` with ``content`` replaced by an integer ``name``: equal for equal contents only.

    ``content`` may be of any type that can be ordered. ``digest`` only deals out the work.
    """
    rows = rows.withColumn("digest", digest(F.col(content)).cast("bigint"))
    sorted_contents = rows.groupBy("digest").agg(F.sort_array(F.collect_set(content)).alias("contents"))
    alone = F.size("contents") == 1
    # A digest with one content needs no content to tell its blocks apart.
    places = sorted_contents.select("digest", F.explode(F.when(alone, F.array(F.lit(None).cast(rows.schema[content].dataType))).otherwise(F.col("contents"))).alias("member"))
    numbered = places.repartitionByRange("digest", "member").sortWithinPartitions("digest", "member")
    names = landed(numbered.withColumn("name", F.monotonically_increasing_id()), "block_names")
    if names.filter(F.col("member").isNotNull()).isEmpty():
        return rows.drop(content).join(names.drop("member"), "digest").drop("digest")
    same = (rows["digest"] == names["digest"]) & (names["member"].isNull() | (names["member"] == rows[content]))
    return rows.join(names, same).drop(names["digest"]).drop("digest", "member", content)


def identities(docs: DataFrame, block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per (doc_id, text): doc_id, sha (binary), n_blocks, name, copies (input rows)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    pieces = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), cut.alias("blocks"))
    pieces = pieces.withColumn("n_blocks", F.size("blocks"))
    rows = exploded(pieces, [*_KEY, "n_blocks"], "blocks", "content", "pos").withColumn("copies", F.lit(1).cast("bigint"))
    level = landed(named(rows, "content", digest).withColumn("left", F.col("n_blocks")), "block_level")
    done = []
    while True:
        done.append(level.filter("left = 1").select(*_KEY, "n_blocks", "name", "copies"))
        open_rows = level.filter("left > 1")
        if open_rows.isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = open_rows.groupBy(*_KEY, "n_blocks", "left", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("first"),
            F.max(F.when(~even, F.col("name"))).alias("second"),
            F.sum(F.when(even, F.col("copies"))).alias("copies"),
        )
        pairs = pairs.withColumn("content", F.struct("first", "second")).drop("first", "second")
        level = landed(named(pairs, "content", digest).withColumn("left", F.expr("(left + 1) div 2")), "block_level")
    found = done[0]
    for rest in done[1:]:
        found = found.unionByName(rest)
    return found.groupBy(*_KEY, "n_blocks", "name").agg(F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the largest doc_id stays.
    """
    identity = landed(identities(docs, block, digest), "identities")
    groups = identity.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = landed(groups, "identity_groups")  # read back, both sides of the join are dealt anew and a large group can be split
    found = identity.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "copies"
    )
    names = [c for c in found.columns if c != "copies"]
    once, often = found.filter("copies = 1").select(*names), identity.filter("copies > 1")
    if often.isEmpty():
        return once
    # A row that repeats is given back in portions, dealt out before each is unfolded, so that no task writes them all.
    portions = found.filter("copies > 1").select(*names, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_PORTION})")).alias("portion"))
    size = F.least(F.lit(_PORTION).cast("bigint"), F.col("copies") - F.col("portion") * _PORTION)
    again = portions.withColumn("size", size).repartition("doc_id", "text_sha256", "portion")
    return once.unionByName(again.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("size").cast("int")))).select(*names))
