"""Connected components of large link tables, and links found bucket by bucket.

Both work on tables of integers in the shared folder. Nothing here gathers a bucket, a
component or a list of links in one task or on the driver; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.session import landed


#: So many comparisons per member, at most, are made pair by pair before members of a bucket are linked to one of them first.
PAIRS_PER_MEMBER = 8
#: So many edges, at most, are one partition: dealing out a table of that size costs more tasks and files than it saves.
FEW_EDGES = 1 << 15


def apart(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of an aggregate with its integer key as ``_key``, negated, so that a join on ``~key`` deals both sides anew.

    Only then can a hub's rows, a third of a side perhaps, be split among tasks.
    """
    return rows.select(F.bitwise_not(key).alias("_key"), *[c for c in rows.columns if c != key])


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the smallest neighbour of u."""
    least = apart(edges.groupBy("u").agg(F.min("v").alias("least")), "u")
    return edges.join(least, F.bitwise_not(edges["u"]) == least["_key"]).drop("_key")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (integers u, v): root is the component's smallest node.

    Alternates the two star steps of distributed union-find: every node hands its larger
    neighbours to its smallest one, then its smaller ones, until nothing changes. Both steps
    are a grouped minimum and a join; each round is written to the shared folder. Before the first round
    every node hands its smaller neighbours to the smallest of them; a node that is no other's smaller neighbour then hangs on
    that one alone, and joins its root after the last round, so that rounds cost what the few nodes between cost, however many links a group has.
    Only a table of at most ``FEW_EDGES`` edges, a fixed number, is not dealt out.
    """
    edges = landed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    smaller = apart(edges.select("v").distinct(), "v").withColumn("inner", F.lit(True))
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = landed(least.join(smaller, F.bitwise_not("u") == F.col("_key"), "left").select("u", "least", F.col("inner").isNotNull().alias("inner")), "least")
    handed = edges.join(apart(least, "u"), F.bitwise_not(edges["u"]) == F.col("_key")).filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    core = landed(handed.unionByName(least.filter("inner").select("u", F.col("least").alias("v"))).distinct(), "edges")
    roots = landed(_rooted(core), "roots")
    outer = least.filter("NOT inner").join(apart(roots, "node"), F.bitwise_not("least") == F.col("_key"), "left")
    outer = landed(outer.select("u", "least", "root"), "outer")
    hung = outer.select(F.col("u").alias("node"), F.coalesce("root", "least").alias("root"))
    alone = outer.filter("root IS NULL").select(F.col("least").alias("node"), F.col("least").alias("root")).distinct()  # no link but to those that hang on it
    return landed(roots.unionByName(hung).unionByName(alone), "components")


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``, distinct (u, v) with u > v."""
    few = edges.count() <= FEW_EDGES  # a round makes no more edges than it reads
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        both = both.coalesce(1) if few else both
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        small = _with_least(large)
        small = small.select(F.explode(F.when(F.col("v") != F.col("least"), F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).otherwise(F.array(F.struct("u", "v")))).alias("e"))
        edges = landed(small.select("e.u", "e.v").distinct(), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    # Each node is now linked to its root alone.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked_in_buckets(
    members: DataFrame,
    similar: Callable[[DataFrame], DataFrame],
    stars: int = 4,
    pairs_per_member: int = PAIRS_PER_MEMBER,
    may: Callable[[Column, Column], Column] = lambda one, other: F.lit(True),
    finer: Callable[[DataFrame], DataFrame] | None = None,
    listed: int | None = None,
    later: int | None = None,
) -> DataFrame:
    """Components of the graph that links similar members of a common bucket: (node, root).

    ``members`` is a written table of (bucket, id, other columns), each (bucket, id) once; ``similar`` keeps of a table of
    pairs (u, v) those that are similar; ``may`` tells, of two members as structs of id and other columns, whether
    they can be, and is asked within the join of a bucket. While listing the pairs of a bucket would take more than
    ``pairs_per_member`` comparisons per member, a bucket's members are compared with one of them
    only, and what is linked by then needs no comparison any more; buckets whose members are all linked are left. From the second round
    on ``listed`` comparisons per member are made pair by pair, if it is given, from the third on ``later``: what a round links is gone by then, so
    that large groups of similar members are one component, and ``may`` tells most of the others apart. Members of one component are not counted. After ``stars`` rounds the members of *different* components that still share a bucket are put into the smaller buckets that ``finer`` names (of rows
    with bucket, id, comp, this), where any two similar ones must meet again, and compared pair by pair,
    so no link between components is missed. Nodes without a link are left out.
    """
    found: DataFrame | None = None
    left = members.select("bucket", "id", F.struct(*[c for c in members.columns if c != "bucket"]).alias("this"))
    for turn in range(stars + 1):
        rest = left.withColumn("comp", F.col("id"))
        if found is not None:
            rest = landed(left.join(found, left["id"] == found["node"], "left").select("bucket", "id", "this", F.coalesce("root", "id").alias("comp")), "members")
        one = F.struct(_mixed("id", turn).alias("order"), "this", "comp")
        if found is None:
            size = F.count(F.lit(1))
            mixed = rest.groupBy("bucket").agg(size.alias("n"), (size * size - size).cast("double").alias("apart"), F.min(one).alias("pivot"))
        else:
            # A group of similar members is one component after a round or two, whose own pairs need no comparison.
            of_comp = rest.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("pivot"))
            total, same = F.sum("n").cast("double"), F.sum(F.col("n").cast("double") * F.col("n"))
            mixed = of_comp.groupBy("bucket").agg(F.sum("n").alias("n"), (total * total - same).alias("apart"), F.min("pivot").alias("pivot"))
        mixed = landed(mixed.filter("apart > 0").select("bucket", "n", "apart", F.col("pivot.this").alias("that"), F.col("pivot.comp").alias("pivot_comp")), "mixed")
        size = mixed.agg(F.sum("n").alias("members"), (F.sum("apart") / 2).alias("pairs")).first()
        if not size["members"]:
            break
        limit = [pairs_per_member, *(x for x in (listed, later) if x is not None)]
        few = size["pairs"] <= limit[min(turn, len(limit) - 1)] * size["members"]
        last = turn == stars or few
        if last:
            open_rows = rest.join(mixed.select("bucket"), "bucket")
            if finer is not None and not few:
                open_rows = landed(finer(open_rows), "finer").hint("merge")  # each member's rows are alike, so their files are far smaller than they are in memory
            other = open_rows.select("bucket", F.col("comp").alias("other_comp"), F.col("this").alias("that"))
            pairs = open_rows.join(other, "bucket").filter(F.col("comp") < F.col("other_comp"))
        else:
            pairs = rest.join(mixed, "bucket").filter("comp != pivot_comp")
            left = rest.join(mixed.select("bucket"), "bucket").select("bucket", "id", "this")
        pairs = pairs.filter(may(F.col("this"), F.col("that"))).select(F.least("this.id", "that.id").alias("u"), F.greatest("this.id", "that.id").alias("v"))
        links = landed(similar(pairs.distinct()), "links")
        if not links.isEmpty():
            # What is linked already is one edge per node from here on.
            known = [found.select(F.col("node").alias("u"), F.col("root").alias("v"))] if found is not None else []
            found = components(reduce(DataFrame.unionByName, [links, *known]))
        if last:
            break
    if found is None:
        return members.select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0)
    return found


def _mixed(column: str, turn: int) -> Column:
    """Another order of the members in each round."""
    return F.xxhash64(F.lit(turn), column) if turn else F.col(column)
