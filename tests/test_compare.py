from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import columns, compare, running
from sqlassay.session import landed


def long_table(spark, cases):
    """``{case_id: {side: (columns, rows)}}`` to long results and shapes."""
    rows, shapes = [], []
    for case_id, sides in cases.items():
        for side, (columns, data, *keys) in sides.items():
            shapes.append((case_id, side, columns))
            order = keys[0] if keys else []
            rows += [(case_id, side, i, columns, order, [None if v is None else str(v) for v in r]) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, compare.LONG_SCHEMA), spark.createDataFrame(shapes, compare.SHAPE_SCHEMA)


def statements(spark, rows):
    return spark.createDataFrame(rows, "case_id bigint, gold string, gen string")


def flags(df, name):
    return {r["case_id"]: r[name] for r in df.collect()}


BASE = [("a", 1), ("b", 2), ("b", 2), (None, 3)]


@pytest.fixture(scope="module")
def results(spark):
    shuffled = BASE[:]
    random.Random(3).shuffle(shuffled)
    ab, ba = ["a", "b"], ["b", "a"]
    cases = {
        1: {"gold": (ab, BASE), "gen": (ab, BASE)},
        2: {"gold": (ab, BASE), "gen": (ab, shuffled[::-1] if shuffled == BASE else shuffled)},
        3: {"gold": (ab, BASE), "gen": (ab, [("a", 1), ("b", 2), ("b", 9), (None, 3)])},
        4: {"gold": (ab, BASE), "gen": (["a", "b", "c"], [(*r, 7) for r in BASE])},
        5: {"gold": (ab, BASE), "gen": (ab, [*BASE, ("z", 0)])},
        6: {"gold": (ab, BASE), "gen": (ba, [(b, a) for a, b in BASE])},
        7: {"gold": (ab, []), "gen": (ab, [])},
        8: {"gold": (ab, []), "gen": (["a"], [])},
        9: {"gold": (ab, [("a", 1)]), "gen": (ab, [("a", 1)] * 3)},
        10: {"gold": (ab, []), "gen": (ab, [("a", 1)])},
        11: {"gold": (["x", "y"], [(1, 2), (3, 4)]), "gen": (["y", "x"], [(4, 3), (2, 1)])},
        12: {"gold": (["x", "y"], [(1, 2), (3, 4)]), "gen": (["p", "q"], [(1, 4), (3, 2)])},
    }
    return long_table(spark, cases)


def test_ordered_equal(results):
    found = flags(compare.ordered_equal(*results), "ordered_equal")
    assert {c for c, ok in found.items() if ok} == {1, 7}


def test_one_row_never_stands_for_many(results):
    found = flags(compare.ordered_equal(*results), "ordered_equal")
    assert not found[9] and not found[10]


def test_set_equal(results):
    found = flags(compare.set_equal(*results), "set_equal")
    assert {c for c, ok in found.items() if ok} == {1, 2, 6, 7, 9, 11}


def test_changed_cell_shows_in_diff(results):
    diff = {(r["case_id"], tuple(r["row"])): (r["missing"], r["extra"]) for r in compare.multiset_diff(results[0]).collect()}
    assert diff[(3, ("b", "2"))] == (1, 0) and diff[(3, ("b", "9"))] == (0, 1)
    assert diff[(9, ("a", "1"))] == (0, 2)
    assert not [k for k in diff if k[0] in (1, 2, 6)]


def test_sequence_equal_takes_first_positions(results):
    found = flags(compare.sequence_equal(*results), "sequence_equal")
    assert found[1] and found[9] and found[7]
    assert not found[3] and not found[5] and not found[11]


def test_columns_are_paired_left_to_right(results):
    pairs = {(r[0], r[1]): r[2] for r in compare.column_match(results[0]).collect()}
    assert pairs[(4, 0)] == 0 and pairs[(4, 1)] == 1
    assert pairs[(6, 0)] == 1 and pairs[(6, 1)] == 0
    assert pairs[(3, 1)] is None


def test_subset_allows_columns_but_no_rows(results):
    found = flags(compare.subset_match(*results), "subset_match")
    assert found[4] and found[1] and found[6]
    assert not found[5] and not found[9] and not found[7]
    assert not found[12], "columns match one by one, rows do not"


def test_verdicts_by_question(spark, results):
    rows = [(c, "Sort them" if c in (2, 11) else "List them", "default") for c in range(1, 13)]
    cases = spark.createDataFrame(rows, "case_id bigint, question string, query_category string")
    found = {r["case_id"]: (r["exact_match"], r["correct"]) for r in compare.verdicts(cases, *results).collect()}
    assert found[1] == (1, 1) and found[4] == (0, 1) and found[5] == (0, 0)
    assert found[7] == (1, 1) and found[8] == (0, 0) and found[10] == (0, 0)
    # Order matters there and the statements leave it open.
    assert found[2][0] == 0 and found[11][0] == 0


def test_order_keys_move_last(spark):
    gold = (["k", "v"], [(1, "a"), (2, "b")], ["k"])
    gen = (["v", "z"], [("b", 2), ("a", 1)], ["z"])
    results, shapes = long_table(spark, {1: {"gold": gold, "gen": gen}})
    assert flags(compare.set_equal(results, shapes), "set_equal")[1]


def test_busy_case_agrees_with_brute_force(spark):
    rng = random.Random(5)
    cases = {}
    for case in range(6):
        n = 3000 if case == 0 else 20
        gold = [(rng.randrange(n), rng.choice("ab")) for _ in range(n)]
        gen = gold[:] if case % 2 == 0 else gold[:-1] + [(-1, "a")]
        rng.shuffle(gen)
        cases[case] = {"gold": (["x", "y"], gold), "gen": (["x", "y"], gen)}
    results, shapes = long_table(spark, cases)
    expected = {c: set(s["gold"][1]) == set(s["gen"][1]) for c, s in cases.items()}
    assert flags(compare.set_equal(results, shapes), "set_equal") == expected
    assert flags(compare.subset_match(results, shapes), "subset_match") == {
        c: sorted(s["gold"][1]) == sorted(s["gen"][1]) for c, s in cases.items()
    }


def test_sequence_across_position_chunks(spark, monkeypatch):
    monkeypatch.setattr(compare, "POSITIONS_PER_CHUNK", 7)
    rows = [(i,) for i in range(100)]
    swapped = rows[:]
    swapped[50], swapped[51] = swapped[51], swapped[50]
    cases = {1: {"gold": (["x"], rows), "gen": (["x"], rows)}, 2: {"gold": (["x"], rows), "gen": (["x"], swapped)}}
    assert flags(compare.sequence_equal(*long_table(spark, cases)), "sequence_equal") == {1: True, 2: False}


def test_order_keys_read_all_keys(spark):
    texts = {
        1: "select a from t order by x.a desc,\n b, count(c, d) asc nulls last limit 3",
        2: "select a from (select b from u order by b) q where c in (1, 2)",
        3: "select a from t",
        4: 'select a from t order by "Unit Price"; ',
    }
    cases = spark.createDataFrame(list(texts.items()), "case_id bigint, query string")
    found = [tuple(r) for r in compare.order_keys(cases).orderBy("case_id", "key_no").collect()]
    assert found == [
        (1, 1, "a", False), (1, 2, "b", True), (1, 3, "count(c, d)", True), (2, 1, "b", True), (4, 1, "unit price", True),
    ]


def test_braces_smallest_first(spark):
    alternatives = spark.createDataFrame([(1, 0, "SELECT {a, b, c} FROM t GROUP BY {}")], "case_id bigint, alternative int, alternative_sql string")
    found = [r["variant_sql"] for r in compare.expand_braces(alternatives).orderBy("variant").collect()]
    assert found[0] == "SELECT a FROM t GROUP BY a"
    assert [f.count(",") for f in found] == [0, 0, 0, 2, 2, 2, 4]


def by_size(names):
    from itertools import combinations

    return [", ".join(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_every_subset_comes_from_its_number(spark, n):
    names = [f"c{i}" for i in range(n)]
    rows = [(1, 0, "SELECT {" + ",".join(names) + "} FROM t"), (1, 1, "SELECT 1")]
    found = compare.expand_braces(spark.createDataFrame(rows, "case_id bigint, alternative int, alternative_sql string"))
    got = [r["variant_sql"] for r in found.filter("alternative = 0").orderBy("variant").collect()]
    assert got == [f"SELECT {c} FROM t" for c in by_size(names)]
    assert [tuple(r) for r in found.filter("alternative = 1").collect()] == [(1, 1, 0, "SELECT 1")]


def test_wide_braces_are_rows_or_an_error_record(spark):
    wide = lambda n: "SELECT {" + ", ".join(f"c{i}" for i in range(n)) + "} FROM t"
    rows = spark.createDataFrame([(1, 0, wide(21)), (2, 0, wide(30))], "case_id bigint, alternative int, alternative_sql string")
    found = compare.expand_braces(rows)
    assert found.count() == 2**21 - 1
    last = found.filter(f"variant >= {2**21 - 3}").orderBy("variant").collect()
    assert [r["variant_sql"] for r in last] == [wide(21).replace("{c0, ", "").replace("}", ""), wide(21).replace("{", "").replace("}", "")]
    assert [(r["case_id"], r["exec_error_msg"]) for r in compare.too_wide(rows).collect()] == [(2, "Gold query failed to execute: more than 24 columns in braces")]
    assert compare.expand_braces(rows, most=4).count() == 0 and compare.too_wide(rows, most=4).count() == 2


def test_run_cases_end_to_end(spark):
    spark.range(1000).select("id", (F.col("id") % 7).alias("m")).createOrReplaceTempView("numbers")
    spark.range(3).select(F.col("id").alias("j")).createOrReplaceTempView("few")
    cases = [
        (1, "SELECT id FROM numbers WHERE m = 3 ORDER BY id", "SELECT id FROM numbers WHERE m = 3 ORDER BY id DESC"),
        (2, "SELECT m, count(*) AS n FROM numbers GROUP BY m", "SELECT m, count(*) AS c, max(id) FROM numbers GROUP BY m"),
        (3, "SELECT id FROM numbers", "SELECT nothing FROM numbers"),
        (4, "SELECT id, j FROM numbers CROSS JOIN few", "SELECT j, id FROM few CROSS JOIN numbers"),
        (5, "SELECT avg(id) AS a FROM numbers", "SELECT sum(id) / count(*) AS b FROM numbers"),
        (6, "SELECT id FROM numbers WHERE m = 9", "SELECT id FROM numbers WHERE m > 9"),
        (7, "SELECT 1 / m FROM numbers", "SELECT m FROM numbers"),
    ]
    results, shapes, errors = running.run_cases(spark, statements(spark, cases))
    asked = spark.createDataFrame([(c[0], "Sort" if c[0] == 1 else "List", "default") for c in cases], "case_id bigint, question string, query_category string")
    found = {r["case_id"]: r for r in compare.verdicts(asked, results, shapes, errors).collect()}
    got = {c: (r["exact_match"], r["correct"], r["error_db_exec"]) for c, r in found.items()}
    # Both statements of case 1 order their rows, so only the sets count.
    assert got == {
        1: (1, 1, 0), 2: (0, 1, 0), 3: (0, 0, 1), 4: (1, 1, 0), 5: (1, 1, 0), 6: (1, 1, 0), 7: (0, 0, 1),
    }
    assert found[3]["exec_error_msg"].startswith("Generated query failed")
    assert found[7]["exec_error_msg"].startswith("Gold query failed")
    places = results.filter("case_id = 1 and side = 'gold'").select("pos", F.col("row")[0].cast("int").alias("v")).orderBy("pos").collect()
    assert [p["pos"] for p in places] == list(range(len(places)))
    assert [p["v"] for p in places] == sorted(p["v"] for p in places)


def test_slow_statement_is_cut_off(spark):
    spark.range(10).createOrReplaceTempView("tiny")
    slow = "SELECT max(sha2(repeat(cast(id as string), 200), 512)) AS m FROM range(80000000)"
    _, _, errors = running.run_cases(spark, statements(spark, [(1, "SELECT id FROM tiny", slow)]), timeout=2.0)
    assert [(r["case_id"], r["side"]) for r in errors.collect()] == [(1, "gen")]


def test_any_gold_takes_verdicts(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 1), (2, 0, 0), (3, 0, 0)], "case_id int, exact_match int, correct int")
    assert {tuple(r) for r in compare.any_gold(rows).collect()} == {(1, False, True), (2, True, True), (3, False, False)}


def test_rounding_is_half_even_and_zero_means_none(spark):
    df = spark.createDataFrame([(0.125, 7), (0.375, 7)], "x double, y int")
    assert [r["x"] for r in compare.round_all(df, 2).collect()] == [0.12, 0.38]
    assert [r["x"] for r in compare.round_all(df, 0).collect()] == [0.125, 0.375]


def test_cells_of_different_types_agree(spark):
    from sqlassay.functions.cells import cell

    df = spark.sql(
        "SELECT 2 AS i, 2.0D AS d, 2.00BD AS m, 0.00001D AS small, 0.0000100BD AS small_m, 0.1D + 0.2D AS noise, "
        "0.30BD AS plain, 1e9D + 1e-7D AS near, 1000000000 AS far, cast('NaN' AS double) AS nan, 12345678901234567890.12BD AS big, 1e300D AS huge, 100BD AS hundred"
    )
    got = df.select(*[cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got["i"] == got["d"] == got["m"] == "2" and got["nan"] is None and got["hundred"] == "100"
    assert got["small"] == got["small_m"] == "0.00001" and got["noise"] == got["plain"] == "0.3"
    assert got["near"] == got["far"]
    assert got["big"] == "1.234567890123456789012e19" and got["huge"] == "1e300"


def test_form_of_a_cell_follows_its_value_alone(spark):
    from sqlassay.functions.cells import cell

    df = spark.sql(
        "SELECT 1e-21D AS a, 2e-21D AS b, 1e16D AS c, 10000000000000000 AS d, 10000000000000000BD AS e, -1.5e-300D AS f, "
        "1234567890123456789 AS g, 0.0000000000000000125BD AS h, 1.25e-17D AS i, 0.0D AS j, 0.000BD AS k, cast('inf' AS double) AS l, 123456789012345 AS m, 999999999999999.5D AS n"
    )
    got = df.select(*[cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got["a"] == "1e-21" and got["b"] == "2e-21" and got["f"] == "-1.5e-300"
    assert got["c"] == got["d"] == got["e"] == "1e16"
    assert got["g"] == "1.234567890123456789e18" and got["h"] == got["i"] == "1.25e-17"
    assert got["j"] == got["k"] == "0" and got["l"] == "Infinity" and got["m"] == "123456789012345"


def test_twelve_digits_at_every_size(spark):
    from sqlassay.functions.cells import cell

    sizes = [10.0**k for k in range(-20, 18)]
    rows = [(k, 1.234567891 * x, 1.234567894 * x, 1.23456789123 * x, 1.234567891234 * x) for k, x in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    found = df.select("k", *[cell(F.col(c), df.schema[c].dataType).alias(c) for c in "abcd"], F.expr("format_string('%.11e', c)").alias("e")).collect()
    for r in found:
        assert r["a"] != r["b"] and r["c"] == r["d"], r
        assert float(r["a"]) == pytest.approx(1.234567891 * sizes[r["k"]], rel=1e-11, abs=0)
    decimal = spark.sql("SELECT 1.25e-14D AS a, -1.25e-14D AS b, 0.0000000000000125BD AS c, 1e-15D AS d, 0.000000000000001BD AS e")
    got = decimal.select(*[cell(F.col(f.name), f.dataType).alias(f.name) for f in decimal.schema]).first()
    assert got["a"] == got["c"] == "0.0000000000000125" and got["b"] == "-0.0000000000000125" and got["d"] == got["e"]


def test_repeated_names(spark):
    df = spark.sql("SELECT 1 AS b, 2 AS a, 3 AS b")
    assert compare.dedup_names(df).columns == ["b_0", "a", "b_2"]
    assert compare.sort_columns(df).columns == ["a", "b_0", "b_2"]


# ---- tolerance


def near(spark, gold, gen, **sides):
    columns_of = lambda rows: [f"c{i}" for i in range(len(rows[0]))]
    return long_table(spark, {1: {"gold": (columns_of(gold), gold), "gen": (columns_of(gen), gen)}})


@pytest.mark.parametrize(
    ("gold", "gen", "same"),
    [
        (["1.5"], ["1.5000001"], True),
        (["1"], ["1.0000001"], True),
        (["1.5"], ["1.501"], False),
        (["1000000"], ["1000001"], False),  # whole numbers are exact
        (["0.1249999999", "3.5"], ["3.5", "0.1250000001"], True),  # across a rounding edge
        (["1.5", "2.5"], ["1.5000001", "2.6"], False),
        (["1.5", None], ["1.5000001", None], True),
        (["1.5", None], ["1.5000001", "1.5"], False),
        (["0.000000001"], ["0.000000002"], True),  # the absolute part
        (["a", "1.5"], ["a", "1.5000001"], False),  # not numbers alone
        (["1.5"], ["1.5000001", "1.5"], False),
        (["1e20", "2.5"], ["2.5", "1.000001e20"], True),
        (["-1.5"], ["1.5"], False),
    ],
)
def test_values_within_the_tolerance_are_the_same(spark, gold, gen, same):
    results, shapes = near(spark, [(x, i + 5) for i, x in enumerate(gold)], [(i + 5, x) for i, x in enumerate(gen)])
    pairs = {(r["gold_ordinal"], r["gen_ordinal"]) for r in compare.column_match(results).collect()}
    assert ((0, 1) in pairs) == same


def test_near_rows_agree_row_by_row(spark):
    gold = [("x", "1.5"), ("y", "2.5"), ("z", "2.5000001"), ("w", "7")]
    cases = {
        1: {"gold": (["k", "v"], gold), "gen": (["v", "k", "more"], [(f"{v}00000001" if "." in v else v, k, 9) for k, v in gold[::-1]])},
        2: {"gold": (["k", "v"], gold), "gen": (["k", "v"], [("x", "2.50000001"), ("y", "1.50000001"), *gold[2:]])},  # columns near, rows swapped
        3: {"gold": (["k", "v"], gold), "gen": (["k", "v"], [("x", "1.50000001"), ("y", "2.5000001"), ("z", "2.5"), ("w", "7")])},  # near in another order
        4: {"gold": (["k", "v"], gold), "gen": (["k", "v"], gold)},
        5: {"gold": (["k", "v"], gold), "gen": (["k", "v"], [(k, f"{float(v) * 1.1:.6f}") for k, v in gold])},
    }
    results, shapes = long_table(spark, cases)
    assert flags(compare.subset_match(results, shapes), "subset_match") == {1: True, 2: False, 3: True, 4: True, 5: False}
    asked = spark.createDataFrame([(c, "List", "default") for c in cases], "case_id bigint, question string, query_category string")
    found = {r["case_id"]: (r["exact_match"], r["correct"]) for r in compare.verdicts(asked, results, shapes).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (0, 1), 4: (1, 1), 5: (0, 0)}
    strict = flags(compare.subset_match(results, shapes, rtol=0.0, atol=0.0), "subset_match")
    assert strict == {1: False, 2: False, 3: False, 4: True, 5: False}


def test_ranks_of_a_long_column_with_one_frequent_value(spark):
    rng = random.Random(6)
    gold = [(i, "0.5" if i % 3 else f"{rng.random():.9f}") for i in range(2000)]
    gen = [(f"{float(v) + 1e-10:.12f}", i) for i, v in gold]
    rng.shuffle(gen)
    results, shapes = near(spark, gold, gen)
    assert flags(compare.subset_match(results, shapes), "subset_match") == {1: True}
    wanted = spark.createDataFrame([(1, 1, 0)], "case_id bigint, gold_ordinal int, gen_ordinal int")
    ranks = columns.ranked(results, wanted).collect()
    for side, ordinal, rows in (("gold", 1, [v for _, v in gold]), ("gen", 0, [v for v, _ in gen])):
        got = sorted((r["rank"], r["value"]) for r in ranks if r["side"] == side and r["ordinal"] == ordinal)
        assert got == list(enumerate(sorted(map(float, rows))))


# ---- verdicts in few passes


def brute_verdicts(cases, questions):
    out = {}
    for case, sides in cases.items():
        (gold_names, gold, *_), (gen_names, gen, *_) = sides["gold"], sides["gen"]
        gold, gen = ([tuple(None if v is None else str(v) for v in r) for r in rows] for rows in (gold, gen))
        ordered = len(gold_names) == len(gen_names) and gold == gen
        by_name = lambda names, rows: [tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows]
        a, b = by_name(gold_names, gold), by_name(gen_names, gen)
        if "sort" in questions[case].lower():
            alike = list(dict.fromkeys(a)) == list(dict.fromkeys(b))
        else:
            alike = set(a) == set(b)
        exact = ordered or (len(gold_names) == len(gen_names) and alike)
        picks = []
        for i in range(len(gold_names) if gold else 0):
            column = sorted(r[i] or "" for r in gold)
            picks.append(next((j for j in range(len(gen_names)) if j not in picks and sorted(r[j] or "" for r in gen) == column), None))
        inside = bool(gold) and None not in picks and set(gold) == {tuple(r[j] for j in picks) for r in gen}
        out[case] = (int(exact), int(exact or inside))
    return out


def test_verdicts_against_brute_force(spark):
    rng = random.Random(17)
    cases, questions = {}, {}
    for case in range(160):
        width = rng.randint(1, 3)
        names = [f"c{i}" for i in range(width)]
        gold = [tuple(rng.choice(["a", "b", "=", None, 1]) for _ in names) for _ in range(rng.randint(0, 5))]
        gen, gen_names = gold[:], names[:]
        for _ in range(rng.randint(0, 2)):
            change = rng.randint(0, 5)
            if change == 0:
                rng.shuffle(gen)
            elif change == 1 and gen:
                gen.append(rng.choice(gen))
            elif change == 2 and gen:
                gen[rng.randrange(len(gen))] = tuple("z" for _ in gen_names)
            elif change == 3:
                gen = [(*r, "more") for r in gen]
                gen_names = [*gen_names, f"n{len(gen_names)}"]
            elif change == 4:
                order = rng.sample(range(len(gen_names)), len(gen_names))
                gen, gen_names = [tuple(r[i] for i in order) for r in gen], [gen_names[i] for i in order]
        cases[case] = {"gold": (names, gold), "gen": (gen_names, gen)}
        questions[case] = rng.choice(["Sort them", "List them"])
    results, shapes = long_table(spark, cases)
    asked = spark.createDataFrame([(c, q, "default") for c, q in questions.items()], "case_id bigint, question string, query_category string")
    found = {r["case_id"]: (r["exact_match"], r["correct"]) for r in compare.verdicts(asked, landed(results, "results"), shapes).collect()}
    assert found == brute_verdicts(cases, questions)


def test_a_null_is_not_an_empty_cell_nor_another_place(spark):
    pairs = {1: ([(None, "a")], [("a", None)]), 2: ([("", None)], [(None, "")]), 3: ([("a", "b")], [("ab", "")]), 4: ([(None,)], [("-",)])}
    cases = {c: {"gold": (["x", "y"][: len(g[0])], g), "gen": (["x", "y"][: len(g[0])], n)} for c, (g, n) in pairs.items()}
    results, shapes = long_table(spark, cases)
    assert not any(flags(compare.set_equal(results, shapes), "set_equal").values())
    assert not any(flags(compare.set_equal(results), "set_equal").values())
    asked = spark.createDataFrame([(c, "List", "default") for c in cases], "case_id bigint, question string, query_category string")
    assert not any(r["exact_match"] for r in compare.verdicts(asked, results, shapes).collect())


def test_verdicts_read_their_results_twice(spark, results, monkeypatch):
    """Sums in one pass, open cases in a second; each shuffles sums or 128 bits a row."""
    rows, shapes = results
    rows, shapes = landed(rows, "results"), landed(shapes, "shapes")
    asked = landed(spark.createDataFrame([(c, "List", "default") for c in range(1, 13)], "case_id bigint, question string, query_category string"), "asked")
    plans = []
    keep = compare.landed

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(compare, "landed", watched)
    plans.append(compare.verdicts(asked, rows, shapes)._jdf.queryExecution().executedPlan().toString())
    folder = rows.inputFiles()[0].split("/sqlassay/")[1].split("/")[0]
    assert sum(plan.count(folder) for plan in plans) <= 2 and not any("Window" in plan for plan in plans)
    assert sum(plan.count(" Exchange hashpartitioning") + plan.count("- Exchange ") - plan.count("- Exchange hashpartitioning") for plan in plans) <= 6, plans


# ---- cases with tables of their own, alternatives, whole runs


def csv(path, name, text):
    folder = path / name.split("/")[0]
    folder.mkdir(exist_ok=True)
    (path / name).write_text(text)
    return str(path / name)


def test_a_case_sees_its_own_files_only(spark, tmp_path):
    a = csv(tmp_path, "one/people.csv", "id,name\n1,Ann\n2,Bob\n")
    b = csv(tmp_path, "two/people.csv", "id,name\n7,Cy\n")
    pets = csv(tmp_path, "two/pets.csv", "pet,owner\nRex,7\n")
    tables = running.shared_tables(spark, [a, b, pets, a])
    spark.range(1).createOrReplaceTempView("outer_view")
    rows = [
        (1, "SELECT name FROM people", "SELECT name FROM people ORDER BY id", [a]),
        (2, "SELECT name FROM people", "SELECT p.name FROM people p JOIN pets ON owner = id", [b, pets]),
        (3, "SELECT name FROM people", "SELECT pet FROM pets", [a]),  # another case's table
        (4, "SELECT * FROM outer_view", "SELECT 1", [a]),
        (5, "SELECT id FROM outer_view", "SELECT id FROM outer_view", None),
        (6, "SELECT 1", "SELECT 1", [a, b]),  # one name twice
        (7, "SELECT 1", "SELECT 1", ["/nowhere.csv"]),
    ]
    cases = spark.createDataFrame(rows, "case_id bigint, gold string, gen string, files array<string>")
    results, shapes, errors = running.run_cases(spark, cases, tables)
    cells = {}
    for r in results.collect():
        cells.setdefault((r["case_id"], r["side"]), []).append(r["row"][0])
    assert sorted(cells[1, "gold"]) == ["Ann", "Bob"] and cells[2, "gold"] == cells[2, "gen"] == ["Cy"] and cells[5, "gold"] == ["0"]
    failed = {(r["case_id"], r["side"]): r["exec_error_msg"] for r in errors.collect()}
    assert set(failed) == {(3, "gen"), (4, "gold"), (6, "gold"), (6, "gen"), (7, "gold"), (7, "gen")}
    assert "TABLE_OR_VIEW_NOT_FOUND" in failed[3, "gen"] and "people" in failed[6, "gold"] and "/nowhere.csv" in failed[7, "gen"]
    assert not spark.catalog.tableExists("people")


def test_folders_do_not_grow_with_the_cases(spark, tmp_path):
    import glob
    import os

    cases = spark.range(60).select(F.col("id").alias("case_id"), F.concat(F.lit("SELECT "), F.col("id"), F.lit(" AS x")).alias("gold"), F.lit("SELECT 7").alias("gen"))
    results, shapes, errors = running.run_cases(spark, cases.repartition(3), at_once=4)
    assert results.count() == 120 and shapes.count() == 120 and errors.count() == 0
    assert {r["case_id"]: r["row"][0] for r in results.filter("side = 'gold'").collect()} == {i: str(i) for i in range(60)}
    root = os.path.dirname(os.path.dirname(results.inputFiles()[0].replace("file://", "").replace("file:", "")))
    assert len(glob.glob(f"{root}/slot=*")) == 4


def test_rows_of_an_unfinished_statement_do_not_count(spark, monkeypatch):
    spark.createDataFrame([(1,), (0,)], "m int").repartition(2, "m").createOrReplaceTempView("some")
    results, shapes, errors = running.run_cases(spark, statements(spark, [(1, "SELECT m FROM some", "SELECT 1 / m FROM some")]))
    assert {r["side"] for r in results.collect()} == {"gold"} and [r["side"] for r in errors.collect()] == ["gen"]
    nothing = running.run_cases(spark, statements(spark, []))
    assert [df.count() for df in nothing] == [0, 0, 0]


def test_benchmark_from_cases_to_summary(spark, tmp_path):
    from sqlassay.sources.results import run_history, write_results

    spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.5)], "id int, k string, v double").createOrReplaceTempView("things")
    rows = [
        (1, "List", "default", "SELECT {id, k} FROM things; SELECT v FROM things", "SELECT k FROM things", None, 0.5),
        (2, "List", "default", "SELECT k FROM things", "SELECT k, v FROM things", "", 1.5),
        (3, "List", "default", "SELECT v FROM things", "SELECT v * 1.0000001D AS w FROM things", "", 1.0),
        (4, "List", "default", "SELECT nothing FROM things; SELECT k FROM things", "SELECT k FROM things", "", 1.0),
        (5, "List", "default", "SELECT k FROM things", "SELECT nothing FROM things", "", 1.0),
        (6, "List", "default", "SELECT k FROM things", None, "model said no", 1.0),
        (7, "List", "default", "SELECT k FROM things", " ", "", 1.0),
        (8, "List", "default", " ; ", "SELECT k FROM things", "", 1.0),
        (9, "List", "default", "SELECT {" + ", ".join("k" * 9) + "} FROM things", "SELECT k FROM things", "", 1.0),
    ]
    cases = spark.createDataFrame(rows, "case_id bigint, question string, query_category string, query string, gen string, generation_error_msg string, latency_seconds double")
    found, total = running.benchmark(spark, cases, most=8)
    outcomes = {r["case_id"]: r["outcome"] for r in found.collect()}
    assert outcomes == {
        1: "exact", 2: "subset", 3: "subset", 4: "exact", 5: "execution_error", 6: "generation_error", 7: "generation_error", 8: "execution_error", 9: "execution_error",
    }
    (row,) = total.collect()
    assert (row["processed"], row["correct"], row["exact"], row["generation_errors"], row["execution_errors"]) == (9, 4, 2, 2, 3)
    write_results(found.drop("outcome", "skip_message"), str(tmp_path / "run"), run="run_id")
    assert run_history(spark, str(tmp_path / "run"), "question string").count() == 9
