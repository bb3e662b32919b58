"""Compare expected and generated result tables for many cases at once.

Results of all cases live in one long table (see ``LONG_SCHEMA``): a row per result row
with the case, the side (``gold`` or ``gen``), the position, the column names and the
canonical cells. ``shapes`` holds one row per (case, side), so that an empty result is
still known. Every verdict is a grouped aggregate; nothing loops over cases.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlassay.functions import sqltext
from sqlassay.functions.cells import cell, rounded
from sqlassay.functions.rows import exploded, let
from sqlassay.operators import columns
from sqlassay.operators.ordered import previous_row
from sqlassay.session import landed

LONG_SCHEMA = (
    "case_id bigint, side string, pos bigint, columns array<string>, order_keys array<string>, row array<string>"
)
SHAPE_SCHEMA = "case_id bigint, side string, columns array<string>"
POSITIONS_PER_CHUNK = 1_000_000


# --- one pair of tables -------------------------------------------------------------


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_names(df: DataFrame) -> DataFrame:
    """Rename every repeated column to ``name_<index>``."""
    names = df.columns
    return df.toDF(*[f"{n}_{i}" if names.count(n) > 1 else n for i, n in enumerate(names)])


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order; repeated names are told apart first."""
    df = dedup_names(df)
    return df.select(*[f"`{n}`" for n in sorted(df.columns)])


def round_all(df: DataFrame, decimals: int | None) -> DataFrame:
    return df.select(*[rounded(F.col(f"`{f.name}`"), f.dataType, decimals).alias(f.name) for f in df.schema])


def to_long(
    df: DataFrame,
    case_id: Column,
    side: str,
    pos: Column,
    columns: Sequence[str],
    order_keys: Sequence[str] = (),
    decimals: int | None = None,
    present: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows of ``df`` in the long form; ``present`` says per row whether a column belongs to its case."""
    types = {f.name: f.dataType for f in df.schema}
    present = present or {}

    def kept(values: dict[str, Column]) -> Column:
        parts = [
            F.when(present[n], F.array(v)).otherwise(F.array().cast("array<string>")) if n in present else F.array(v)
            for n, v in values.items()
        ]
        return F.concat(*parts)

    return df.select(
        case_id.cast("bigint").alias("case_id"),
        F.lit(side).alias("side"),
        pos.cast("bigint").alias("pos"),
        kept({n: F.lit(n) for n in columns}).alias("columns"),
        F.array(*[F.lit(k) for k in order_keys]).cast("array<string>").alias("order_keys"),
        kept({n: cell(F.col(f"`{n}`"), types[n], decimals) for n in columns}).alias("row"),
    )


def shapes_of(results: DataFrame) -> DataFrame:
    """Column names per (case, side), for results known not to be empty."""
    return results.groupBy("case_id", "side").agg(F.max("columns").alias("columns"))


def _case_shapes(shapes: DataFrame) -> DataFrame:
    gold = F.max(F.when(F.col("side") == "gold", F.col("columns")))
    gen = F.max(F.when(F.col("side") == "gen", F.col("columns")))
    return shapes.groupBy("case_id").agg(gold.alias("gold_columns"), gen.alias("gen_columns"))


def _on_side(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def _arranged(columns: Column, order_keys: Column, row: Column) -> Column:
    """Cells with columns in name order; ORDER BY keys, where given, move to the end."""
    keyed = F.transform(
        F.arrays_zip(columns.alias("n"), row.alias("v")),
        lambda c: F.struct(
            F.coalesce(F.array_position(order_keys, c["n"]), F.lit(0)).alias("last"), c["n"].alias("n"), c["v"].alias("v")
        ),
    )
    as_is = (F.sort_array(columns) == columns) & (F.size(order_keys) == 0)
    return F.when(as_is, row).otherwise(F.transform(F.array_sort(keyed), lambda c: c["v"]))


def arranged(results: DataFrame) -> DataFrame:
    return results.withColumn("row", _arranged(F.col("columns"), F.col("order_keys"), F.col("row")))


# --- verdicts per case --------------------------------------------------------------


def _in_place(results: DataFrame) -> DataFrame:
    pairs = results.groupBy("case_id", "pos").agg(
        F.max(_on_side("gold", F.col("row"))).alias("gold"), F.max(_on_side("gen", F.col("row"))).alias("gen")
    )
    equal = F.col("gold").isNotNull() & F.col("gen").isNotNull() & F.col("gold").eqNullSafe(F.col("gen"))
    return pairs.groupBy("case_id").agg(F.bool_and(equal).alias("same_rows"))


def _with_widths(same: DataFrame, shapes: DataFrame, name: str) -> DataFrame:
    """Cases without rows are equal if both sides have the same number of columns."""
    return (
        _case_shapes(shapes)
        .join(same, "case_id", "left")
        .select("case_id", (_same_width() & F.coalesce("same_rows", F.lit(True))).alias(name))
    )


def _same_width() -> Column:
    return F.coalesce(F.size("gold_columns") == F.size("gen_columns"), F.lit(False))


def ordered_equal(results: DataFrame, shapes: DataFrame) -> DataFrame:
    """Same cells at the same row and column positions; names do not matter."""
    return _with_widths(_in_place(results), shapes, "ordered_equal")


def set_equal(results: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Equal as sets of rows once columns are arranged; a null equals a null.

    Without ``shapes`` the widths are read in the same pass; a case without any row is then unknown.
    """
    if shapes is not None:
        return _with_widths(_set_difference(arranged(results)), shapes, "set_equal")
    rows = results.select("case_id", "side", F.size("columns").alias("width"), *columns.hashes(columns.marked(_arranged(F.col("columns"), F.col("order_keys"), F.col("row")))))
    width = lambda side: F.max(_on_side(side, F.col("width"))).alias(side)
    seen = rows.groupBy("case_id", "a", "b").agg(width("gold"), width("gen"))
    both = F.bool_and(F.col("gold").isNotNull() & F.col("gen").isNotNull()) & (F.max("gold") == F.max("gen"))
    return seen.groupBy("case_id").agg(F.coalesce(both, F.lit(False)).alias("set_equal"))


def _set_difference(results: DataFrame) -> DataFrame:
    """case_id and same_rows: rows meet as 128 bits, not as texts."""
    seen = results.select("case_id", "side", *columns.hashes(columns.marked(F.col("row")))).groupBy("case_id", "a", "b").agg(
        F.bool_or(F.col("side") == "gold").alias("in_gold"), F.bool_or(F.col("side") == "gen").alias("in_gen")
    )
    return seen.groupBy("case_id").agg(F.bool_and(F.col("in_gold") & F.col("in_gen")).alias("same_rows"))


def multiset_diff(results: DataFrame) -> DataFrame:
    """Rows missing from or extra in the generated result, with counts."""
    signed = F.when(F.col("side") == "gold", F.lit(1)).otherwise(F.lit(-1))
    balance = arranged(results).groupBy("case_id", "row").agg(F.sum(signed).alias("balance"))
    return balance.filter("balance <> 0").select(
        "case_id",
        "row",
        F.greatest("balance", F.lit(0)).alias("missing"),
        F.greatest(-F.col("balance"), F.lit(0)).alias("extra"),
    )


def sequence_equal(results: DataFrame, shapes: DataFrame) -> DataFrame:
    """Equal as sequences of distinct rows, each at its first position.

    Two sequences of the same distinct rows are the same if going through them in gold
    order also goes forward in the generated order. That needs the preceding row only.
    """
    return _with_widths(_in_sequence(results), shapes, "sequence_equal")


def _in_sequence(results: DataFrame) -> DataFrame:
    first = lambda side: F.min(_on_side(side, F.col("pos"))).alias(side)
    return _forward(arranged(results).groupBy("case_id", "row").agg(first("gold"), first("gen")), ["row"])


def _forward(places: DataFrame, row: Sequence[str]) -> DataFrame:
    """case_id and same_rows: does going through ``places`` (a distinct row, its first position on both sides) in gold order go forward in the other?"""
    placed = previous_row(
        places.withColumn("__at", F.coalesce("gold", F.lit(-1))),
        ["case_id"],
        ["__at", "gen", *row],
        # Rows of the generated result alone decide their case wherever they stand: they are dealt by their own place.
        F.coalesce(F.floor(F.col("gold") / F.lit(POSITIONS_PER_CHUNK)), -1 - F.floor(F.col("gen") / F.lit(POSITIONS_PER_CHUNK))).cast("bigint"),
        ["gen"],
        "before",
    )
    forward = F.col("before").isNull() | F.coalesce(F.col("before.gen") < F.col("gen"), F.lit(False))
    both = F.col("gold").isNotNull() & F.col("gen").isNotNull()
    return placed.groupBy("case_id").agg(F.bool_and(both & forward).alias("same_rows"))


def _paired(results: DataFrame, found: DataFrame, rtol: float, atol: float) -> tuple[DataFrame, bool]:
    """``found`` (rows of ``columns.per_case``, written down) with ``picks`` and the places of ``near`` ones; and whether there are any."""
    none = F.array().cast("array<struct<gold_ordinal:int,gen_ordinal:int>>")
    maybe = found.select("case_id", F.inline(columns.maybe_near(rtol, atol)))
    any_near = not maybe.isEmpty()
    if any_near:
        near = columns.near_pairs(results, landed(maybe, "maybe_near"), rtol, atol)
        found = found.join(near, "case_id", "left")
    found = found.withColumn("near", F.coalesce("near", none) if any_near else none).withColumn("picks", columns.picks(F.col("near")))
    taken = F.filter("near", lambda p: F.get("picks", p["gold_ordinal"]) == p["gen_ordinal"])
    found = found.withColumn("near", F.transform(taken, lambda p: p["gold_ordinal"]))
    return landed(found, "picks") if any_near else found, any_near


def column_match(results: DataFrame, rtol: float = columns.RTOL, atol: float = columns.ATOL) -> DataFrame:
    """Pair gold and generated columns with the same multiset of values, left to right, each once.

    Values with fractions may differ by ``atol`` + ``rtol`` times the generated value, sorted column by sorted column.
    """
    found, _ = _paired(results, landed(columns.per_case(columns.sums(results)), "column_sums"), rtol, atol)
    pairs = F.transform("gold", lambda x, i: F.struct(x["ordinal"].alias("gold_ordinal"), F.nullif(F.get("picks", i), F.lit(-1)).alias("gen_ordinal")))
    return found.select("case_id", F.inline(pairs))


def _picked(side: Column, row: Column, picks: Column) -> Column:
    return F.when(side == "gold", row).otherwise(F.transform(picks, lambda i: F.get(row, i)))


def _contained(results: DataFrame, found: DataFrame, any_near: bool, rtol: float, atol: float) -> DataFrame:
    """case_id and same_rows of the cases whose gold columns all have a partner: do they agree row by row?"""
    whole = found.filter("size(gold) > 0 AND NOT array_contains(picks, -1)").select("case_id", "picks", "near")
    # The list of picks is one small row per case; AQE broadcasts it when its measured size
    # allows and splits a busy case otherwise.
    rows = results.join(whole, "case_id").select("case_id", "side", "pos", _picked(F.col("side"), F.col("row"), F.col("picks")).alias("row"), F.col("near").alias("places"))
    exact = _set_difference(rows.filter("size(places) = 0"))
    return exact.unionByName(columns.near_rows(rows.filter("size(places) > 0"), rtol, atol)) if any_near else exact


def subset_match(results: DataFrame, shapes: DataFrame, rtol: float = columns.RTOL, atol: float = columns.ATOL) -> DataFrame:
    """Gold is contained in the generated result: extra columns may occur, extra rows may not.

    An empty gold result is contained in nothing. Values within the tolerance count as the same.
    """
    found, any_near = _paired(results, landed(columns.per_case(columns.sums(results)), "column_sums"), rtol, atol)
    contained = _contained(results, found, any_near, rtol, atol)
    return shapes.select("case_id").distinct().join(contained, "case_id", "left").select("case_id", F.coalesce("same_rows", F.lit(False)).alias("subset_match"))


# --- questions and gold alternatives ------------------------------------------------


def order_sensitive(cases: DataFrame) -> DataFrame:
    flag = (F.col("query_category") == "order_by") | F.col("question").rlike(r"(?i)\b(order|sort|arrange)\b")
    return cases.withColumn("order_sensitive", F.coalesce(flag, F.lit(False)))


def order_keys(cases: DataFrame, sql: str = "query") -> DataFrame:
    """One row per ORDER BY key with its own direction, ascending unless DESC is written."""
    keys = exploded(cases, ["case_id"], sqltext.order_items(F.col(sql)), "item", "key_no")
    return keys.select(
        "case_id",
        (F.col("key_no") + 1).alias("key_no"),
        F.lower(sqltext.order_item_name(F.col("item"))).alias("key_name"),
        (~F.col("item").rlike(r"(?i)\bdesc\b")).alias("ascending"),
    )


def alternatives(cases: DataFrame, sql: str = "query") -> DataFrame:
    """Gold text split at ``;`` into alternatives, blank parts dropped."""
    parts = F.filter(F.transform(F.split(F.col(sql), ";"), lambda p: F.trim(p)), lambda p: p != "")
    return exploded(cases, ["case_id"], parts, "alternative_sql", "alternative")


#: Columns in one pair of braces that are expanded unless the caller says otherwise: 2^n - 1 statements.
BRACE_COLUMNS = 24
_VARIANTS_PER_ROW = 1 << 14


def _brace_names(text: Column) -> Column:
    return F.transform(F.split(F.regexp_extract(text, r"\{([^}]*)\}", 1), ","), lambda n: F.trim(n))


def _has_braces(text: Column) -> Column:
    return text.rlike(r"\{[^}]*\}")


def _nth_subset(n: Column, nth: Column, most: int) -> Column:
    """The places 0 .. n - 1 in the ``nth`` subset, in order of size and then of its places.

    Computed from its number: first the size, then place by place how many subsets go on with it.
    """
    table = [[math.comb(a, b) for b in range(most + 1)] for a in range(most + 1)]
    literal = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in line) + ")" for line in table) + ")")
    ways = lambda a, b: F.get(F.get(literal, a), b)
    start = F.struct(F.lit(1).alias("size"), nth.cast("bigint").alias("left"))

    def by_size(state: Column, _: Column) -> Column:
        here = ways(n, state["size"])
        return F.when(state["left"] >= here, F.struct((state["size"] + 1).alias("size"), (state["left"] - here).alias("left"))).otherwise(state)

    def by_place(state: Column, place: Column) -> Column:
        here = F.when(state["open"] > 0, ways(n - 1 - place, state["open"] - 1)).otherwise(F.lit(0).cast("bigint"))
        taken = F.struct((state["open"] - 1).alias("open"), state["left"].alias("left"), F.concat(state["places"], F.array(place)).alias("places"))
        passed = F.struct(state["open"].alias("open"), (state["left"] - here).alias("left"), state["places"].alias("places"))
        return F.when((state["open"] > 0) & (state["left"] < here), taken).otherwise(passed)

    sized = F.aggregate(F.sequence(F.lit(1), n), start, by_size)
    empty = F.array().cast("array<int>")
    begun = let(sized, lambda s: F.struct(s["size"].alias("open"), s["left"].alias("left"), empty.alias("places")))
    return F.aggregate(F.sequence(F.lit(0), n - 1), begun, by_place)["places"]


def too_wide(alternatives: DataFrame, sql: str = "alternative_sql", most: int = BRACE_COLUMNS) -> DataFrame:
    """case_id, alternative and the error record of texts whose braces hold more than ``most`` columns."""
    wide = alternatives.filter(_has_braces(F.col(sql)) & (F.size(_brace_names(F.col(sql))) > most))
    message = F.concat(F.lit("Gold query failed to execute: more than "), F.lit(str(most)), F.lit(" columns in braces"))
    return wide.select(*[c for c in wide.columns if c != sql], message.alias("exec_error_msg"))


def expand_braces(alternatives: DataFrame, sql: str = "alternative_sql", most: int = BRACE_COLUMNS) -> DataFrame:
    """``{a, b}`` becomes one statement per non-empty column subset, smallest first.

    The number of statements doubles per column; each is computed from its own number, so no row holds them all. Texts with more than
    ``most`` columns in one pair of braces (62 at most) give no statement here but an error record in ``too_wide``.
    """
    if not 0 < most <= 62:
        raise ValueError("the number of a subset needs 62 bits at most")
    text = F.col(sql)
    keep = [c for c in alternatives.columns if c != sql]
    rows = alternatives.filter(~_has_braces(text) | (F.size(_brace_names(text)) <= most))
    rows = rows.select(*keep, text.alias(sql), F.when(_has_braces(text), _brace_names(text)).alias("_names"))
    count = F.when(F.col("_names").isNull(), F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size("_names")) - 1)
    # Two levels, so that the numbers of a wide text are not one array.
    last = F.floor((count - 1) / F.lit(_VARIANTS_PER_ROW)).cast("bigint")
    rows = rows.select("*", count.alias("_count"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
    first = F.col("_block") * _VARIANTS_PER_ROW
    rows = rows.select("*", F.explode(F.sequence(first, F.least(first + (_VARIANTS_PER_ROW - 1), F.col("_count") - 1))).alias("_nth"))
    places = _nth_subset(F.size("_names"), F.col("_nth"), most)
    chosen = F.array_join(F.transform(places, lambda p: F.get("_names", p)), ", ")
    start = F.instr(text, "{")
    close = F.position(F.lit("}"), text, start)
    left, right = F.substring(text, F.lit(1), start - 1), F.substring(text, close + 1, F.length(text))
    filled = let(chosen, lambda c: F.concat(left, c, F.replace(right, F.lit("GROUP BY {}"), F.concat(F.lit("GROUP BY "), c))))
    number = F.col("_nth").cast("int") if most <= 31 else F.col("_nth")
    return rows.select(*keep, number.alias("variant"), F.when(F.col("_names").isNull(), text).otherwise(filled).alias("variant_sql"))


def any_gold(verdicts: DataFrame) -> DataFrame:
    """Exact if any alternative is exact; correct if any is exact or a subset.

    Takes the rows of ``verdicts``, one per alternative with the ``case_id`` of its case
    (``running.evaluate`` does so), or rows with the flags ``exact`` and ``subset``.
    """
    if "exact_match" in verdicts.columns:
        flags = verdicts.select("case_id", (F.col("exact_match") == 1).alias("exact"), (F.col("correct") == 1).alias("subset"))
        return any_gold(flags)
    return verdicts.groupBy("case_id").agg(
        F.bool_or("exact").alias("exact"), F.bool_or(F.col("exact") | F.col("subset")).alias("correct")
    )


# --- verdicts from sums first --------------------------------------------------------


def _tests(found: DataFrame) -> DataFrame:
    """``found`` with what the sums decide and ``tests``, what only the rows can."""
    ordered = F.col("gold_ordered").eqNullSafe(F.col("gen_ordered"))
    arranged_same = F.col("gold_arranged").eqNullSafe(F.col("gen_arranged"))
    free = ~F.col("order_sensitive") | F.coalesce("both_ordered", F.lit(False))
    decided = ordered | (free & arranged_same)
    rows_on_both = F.col("gold_arranged").isNotNull() & F.col("gen_arranged").isNotNull()
    exact = _same_width() & decided
    may_be = _same_width() & ~decided & rows_on_both
    tests = F.array(F.when(may_be & free, "set"), F.when(may_be & ~free, "sequence"), F.when(~exact & F.col("whole"), "contained"))
    return found.select("case_id", exact.alias("exact"), F.array_compact(tests).alias("tests"), "picks", "near")


def judged(cases: DataFrame, results: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per case from one pass over the rows: sums of whole rows and of columns, flags and column names."""
    as_arranged = _arranged(F.col("columns"), F.col("order_keys"), F.col("row"))
    flags = order_sensitive(cases).select("case_id", "order_sensitive")
    found = columns.per_case(columns.sums(results, as_arranged))
    return flags.join(_case_shapes(shapes), "case_id", "left").join(found, "case_id", "left")


def undecided(results: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of cases that the sums leave open, once per test: case_id, test, side, pos, row as the test reads it, places of near columns."""
    open_cases = found.filter("size(tests) > 0").select("case_id", F.explode("tests").alias("test"), "picks", "near")
    contained = F.col("test") == "contained"
    row = F.when(contained, _picked(F.col("side"), F.col("row"), F.col("picks"))).otherwise(_arranged(F.col("columns"), F.col("order_keys"), F.col("row")))
    places = F.when(contained, F.col("near")).otherwise(F.array().cast("array<int>"))
    return results.join(open_cases, "case_id").select("case_id", "test", "side", "pos", row.alias("row"), places.alias("places"))


def _places(rows: DataFrame) -> DataFrame:
    """case_id, test, a, b and the first positions on both sides; a row travels as 128 bits, not as text."""
    first = lambda side: F.min(_on_side(side, F.col("pos"))).alias(side)
    return rows.select("case_id", "test", "side", "pos", *columns.hashes(columns.marked(F.col("row")))).groupBy("case_id", "test", "a", "b").agg(first("gold"), first("gen"))


def verdicts(
    cases: DataFrame, results: DataFrame, shapes: DataFrame, errors: DataFrame | None = None, rtol: float = columns.RTOL, atol: float = columns.ATOL
) -> DataFrame:
    """One row per case: exact, correct, error flag and message.

    ``cases`` needs ``case_id``, ``question`` and ``query_category``. Exact means equal by
    position, or equal after normalising: as a set, or as a sequence where order matters
    and the statements leave it open. Correct adds the subset match.

    Sums of hashes decide most cases in one pass over ``results``, which should be written down. Only
    cases that they leave open go through a second pass, and only tests that a case needs are planned.
    """
    found, any_near = _paired(results, landed(judged(cases, results, shapes), "judged"), rtol, atol)
    whole = F.coalesce((F.size("gold") > 0) & ~F.array_contains("picks", -1), F.lit(False))
    found = landed(_tests(found.withColumn("whole", whole)), "case_tests")
    asked = {row[0] for row in found.select(F.explode("tests")).distinct().collect()}
    told = found.select("case_id", "exact", *[F.lit(None).cast("boolean").alias(t) for t in ("set", "sequence", "contained")])
    if asked:
        rows = undecided(results, found)
        places = _places(rows.filter("size(places) = 0") if any_near else rows)
        if "sequence" in asked:
            places = landed(places, "places")
        both = F.col("gold").isNotNull() & F.col("gen").isNotNull()
        by_test = places.groupBy("case_id").agg(*[F.bool_and(F.when(F.col("test") == t, both)).alias(t) for t in ("set", "contained")])
        told = told.select("case_id", "exact").join(by_test, "case_id", "left")
        if "sequence" in asked:
            told = told.join(_forward(places.filter("test = 'sequence'"), ["a", "b"]).withColumnRenamed("same_rows", "sequence"), "case_id", "left")
        else:
            told = told.withColumn("sequence", F.lit(None).cast("boolean"))
        if any_near:
            near = columns.near_rows(rows.filter("size(places) > 0"), rtol, atol).withColumnRenamed("same_rows", "alike")
            told = told.join(near, "case_id", "left").withColumn("contained", F.coalesce("contained", "alike")).drop("alike")
    joined = told
    true = lambda name: F.coalesce(name, F.lit(False))
    exact = true("exact") | true("set") | true("sequence")
    message = F.lit("")
    failed = F.lit(False)
    if errors is not None:
        first = errors.groupBy("case_id").agg(F.min_by("exec_error_msg", F.col("side") != "gold").alias("message"))
        joined = joined.join(first, "case_id", "left")
        failed = F.col("message").isNotNull()
        message = F.coalesce("message", F.lit(""))
    return joined.select(
        "case_id",
        F.when(failed, 0).otherwise(exact.cast("int")).alias("exact_match"),
        F.when(failed, 0).otherwise((exact | true("contained")).cast("int")).alias("correct"),
        failed.cast("int").alias("error_db_exec"),
        message.alias("exec_error_msg"),
    )
