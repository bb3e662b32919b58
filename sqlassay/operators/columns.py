"""Which columns of two results hold the same values, many cases at once.

Every column of every case and side is told by one row of sums (``sums``), map-side combined, so a case that holds
a third of all rows is not gathered anywhere. Equal sums are equal columns. Only
where sums differ, but counts, ends and totals allow the values to be equal within the tolerance, both columns are
sorted by ranges, ranked by the sizes of the partitions before, and compared rank by rank.

Numbers are the canonical cells of ``functions.cells``. Whole numbers are compared exactly; as soon as one side of a pair has a
fraction, two values are near if they differ by ``atol`` + ``rtol`` times the generated one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlassay.session import landed

RTOL, ATOL = 1e-5, 1e-8
#: Ordinals of the sums over whole rows: with their positions, and with columns arranged.
ORDERED, ARRANGED = -1, -2
_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?(e-?\d+)?$"


_NULL = "\0null\0"


def marked(row: Column) -> Column:
    """A row for hashing, in which a null is told from a text and from a null elsewhere."""
    return F.struct(F.array_join(row, "\1", _NULL), row)


def hashes(*values: Column) -> list[Column]:
    """128 bits of a value in two columns, ``a`` and ``b``."""
    return [F.xxhash64(F.lit(name), *values).alias(name) for name in "ab"]


def number(cell: Column) -> Column:
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def sums(results: DataFrame, arranged: Column | None = None) -> DataFrame:
    """One row per (case, side, ordinal): counts, two sums of hashes, and of the numbers ends and totals.

    With ``arranged``, the row with its columns arranged, whole rows are summed up beside the columns.
    """
    cells = F.transform(
        F.col("row"),
        lambda v, i: F.struct(
            i.alias("ordinal"), *hashes(v), v.isNotNull().alias("filled"), number(v).alias("number"), F.coalesce(v.rlike("[.e]"), F.lit(False)).alias("broken")
        ),
    )
    if arranged is not None:
        none = [F.lit(True).alias("filled"), F.lit(None).cast("double").alias("number"), F.lit(False).alias("broken")]
        whole = lambda ordinal, *v: F.struct(F.lit(ordinal).alias("ordinal"), *hashes(*v), *none)
        cells = F.concat(F.array(whole(ORDERED, F.col("pos"), marked(F.col("row"))), whole(ARRANGED, marked(arranged))), cells)
    rows = results.select("case_id", "side", (F.size("order_keys") > 0).alias("keyed"), F.inline(cells))
    summed = lambda name: F.sum(F.when(F.col("filled"), F.col(name).cast("decimal(20,0)"))).alias(name)
    return rows.groupBy("case_id", "side", "ordinal").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("filled").alias("filled"),
        summed("a"),
        summed("b"),
        F.count("number").alias("numbers"),
        F.count_if(F.col("broken") & F.col("number").isNotNull()).alias("fractions"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.sum("number").alias("total"),
        F.sum(F.abs("number")).alias("size"),
        F.bool_and("keyed").alias("keyed"),
    )


_PRINT = ["ordinal", "n", "filled", "a", "b", "numbers", "fractions", "low", "high", "total", "size"]


def per_case(found: DataFrame) -> DataFrame:
    """One row per case: lists of the columns' sums of both sides, sums of whole rows, and whether all statements order their rows."""
    on = lambda side, ordinals, value: F.when((F.col("side") == side) & ordinals, value)
    columns = [F.sort_array(F.collect_list(on(side, F.col("ordinal") >= 0, F.struct(*_PRINT)))).alias(side) for side in ("gold", "gen")]
    whole = [
        F.max(on(side, F.col("ordinal") == ordinal, F.struct("n", "a", "b"))).alias(f"{side}_{name}")
        for side in ("gold", "gen")
        for ordinal, name in ((ORDERED, "ordered"), (ARRANGED, "arranged"))
    ]
    return found.groupBy("case_id").agg(*columns, *whole, F.bool_and("keyed").alias("both_ordered"))


def _same(x: Column, y: Column) -> Column:
    same = F.lit(True)
    for name in ("n", "filled", "a", "b"):
        same &= x[name].eqNullSafe(y[name])
    return same


def _close(x: Column, y: Column, rtol: float, atol: float) -> Column:
    return F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)


def maybe_near(rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Pairs (gold_ordinal, gen_ordinal) of a row of ``per_case`` that are not the same but may be near."""

    def possible(x: Column, y: Column) -> Column:
        numbers = (x["filled"] > 0) & (x["numbers"] == x["filled"]) & (y["numbers"] == y["filled"]) & (x["fractions"] + y["fractions"] > 0)
        slack = y["n"] * F.lit(atol) + (y["size"] + x["size"]) * F.lit(rtol)
        ends = _close(x["low"], y["low"], rtol, atol) & _close(x["high"], y["high"], rtol, atol)
        return ~_same(x, y) & (x["n"] == y["n"]) & (x["filled"] == y["filled"]) & numbers & ends & (F.abs(x["total"] - y["total"]) <= slack)

    pair = lambda x, y: F.struct(x["ordinal"].alias("gold_ordinal"), y["ordinal"].alias("gen_ordinal"))
    return F.flatten(F.transform("gold", lambda x: F.transform(F.filter("gen", lambda y: possible(x, y)), lambda y: pair(x, y))))


def picks(near: Column) -> Column:
    """For each gold column the first generated column not taken yet that is the same or in ``near``; -1 for none."""

    def next_pick(taken: Column, x: Column) -> Column:
        fits = lambda y: _same(x, y) | F.exists(near, lambda p: (p["gold_ordinal"] == x["ordinal"]) & (p["gen_ordinal"] == y["ordinal"]))
        found = F.filter("gen", lambda y: ~F.array_contains(taken, y["ordinal"]) & fits(y))
        return F.concat(taken, F.array(F.coalesce(F.get(found, 0)["ordinal"], F.lit(-1))))

    return F.aggregate("gold", F.array().cast("array<int>"), next_pick)


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their rank, from 0 on, in ``order`` within ``group``.

    Sorted by ranges of everything, written down, and counted by partition: neither a large group nor a frequent value is one task.
    """
    rows = landed(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id()), "sorted_rows")
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, [*group, "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("offset")).drop("at", "part", "first", "offset")


def ranked(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """case_id, side, ordinal, value and rank of the columns that ``wanted`` (case_id, gold_ordinal, gen_ordinal) names."""
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_ordinal").alias("ordinal")) for s in ("gold", "gen")]))
    ordinals = wanted.select("case_id", sides).groupBy("case_id", "side").agg(F.collect_set("ordinal").alias("ordinals"))
    group = ["case_id", "side", "ordinal"]
    values = results.join(ordinals, ["case_id", "side"]).select("case_id", "side", "pos", "row", F.explode("ordinals").alias("ordinal"))
    values = values.select(*group, "pos", number(F.get("row", F.col("ordinal"))).alias("value")).filter("value IS NOT NULL")
    return _ranked(values, group, ["value", "pos"]).drop("pos")


def near_pairs(results: DataFrame, wanted: DataFrame, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """case_id and near: the wanted pairs whose sorted values are near at every rank."""
    values = landed(ranked(results, wanted), "ranked_values")
    side = lambda s: values.filter(F.col("side") == s).select("case_id", F.col("ordinal").alias(f"{s}_ordinal"), "rank", F.col("value").alias(s))
    rows = side("gold").join(wanted, ["case_id", "gold_ordinal"]).join(side("gen"), ["case_id", "gen_ordinal", "rank"])
    near = rows.groupBy("case_id", "gold_ordinal", "gen_ordinal").agg(F.bool_and(_close(F.col("gold"), F.col("gen"), rtol, atol)).alias("near"))
    return near.filter("near").groupBy("case_id").agg(F.collect_list(F.struct("gold_ordinal", "gen_ordinal")).alias("near"))


def near_rows(rows: DataFrame, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """case_id and same_rows for ``rows`` (case_id, side, pos, row in gold order, places of near columns).

    Rows with the same other cells are sorted by their near values on both sides and compared rank by rank.
    """
    is_near = lambda i: F.array_contains("places", i)
    # Of a near cell the other part keeps whether it is null.
    others = F.transform("row", lambda v, i: F.when(is_near(i), F.when(v.isNull(), "null").otherwise("number")).otherwise(F.coalesce(F.concat(F.lit("="), v), F.lit("-"))))
    values = F.filter(F.transform("row", lambda v, i: F.when(is_near(i), number(v))), lambda x: x.isNotNull())
    rows = _ranked(rows.select("case_id", "side", "pos", *hashes(others), values.alias("values")), ["case_id", "side", "a", "b"], ["values", "pos"])
    on = lambda side: F.max(F.when(F.col("side") == side, F.col("values"))).alias(side)
    pairs = rows.groupBy("case_id", "a", "b", "rank").agg(on("gold"), on("gen"))
    close = F.forall(F.zip_with("gold", "gen", lambda x, y: _close(x, y, rtol, atol)), lambda ok: ok)
    return pairs.groupBy("case_id").agg(F.bool_and(F.coalesce(close, F.lit(False))).alias("same_rows"))
