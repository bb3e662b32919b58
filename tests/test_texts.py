from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sqlassay.functions import text as tx
from sqlassay.operators import candidates as cd
from sqlassay.operators import judge, prompts, summary
from sqlassay.operators import textmetrics as tm


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("output", "reference", "score"),
    [("apple", "apply", 0.8), ("sitting", "kitten", 4 / 7), ("", "", 1.0), ("", "ab", 0.0), ("é", "e", 0.0)],
)
def test_levenshtein(spark, output, reference, score):
    assert one(spark, tx.levenshtein_score(F.lit(output), F.lit(reference))) == pytest.approx(score)


def test_levenshtein_of_null(spark):
    null = F.lit(None).cast("string")
    assert one(spark, tx.levenshtein_score(null, F.lit("a"))) == 0.0
    assert one(spark, tx.levenshtein_distance(null, F.lit("a"))) == -1


@pytest.mark.parametrize(("text", "valid"), [("{}", 1.0), ("null", 1.0), ("3", 1.0), ("", 0.0), ("{a}", 0.0), ("[1,", 0.0)])
def test_json(spark, text, valid):
    assert one(spark, tx.json_score(F.lit(text))) == valid


@pytest.mark.parametrize(
    ("text", "inside"),
    [
        ("a ```sql\nSELECT 1\n``` b ```sql\nSELECT 2```", "SELECT 1"),
        ("```json\n[1]\n```", "[1]"),
        ("```\nplain\n```", "plain"),
        ("```sql SELECT 1", "SELECT 1"),
        ("  no fence ", "no fence"),
    ],
)
def test_fences(spark, text, inside):
    assert one(spark, tx.strip_fences(F.lit(text))) == inside


def test_filled_text_is_not_filled_again(spark):
    fields = {"a": F.lit("{b}"), "b": F.lit("B")}
    assert one(spark, tx.fill("{a} {b} {other} {", fields)) == "{b} B {other} {"
    assert one(spark, tx.fill_from(F.lit("{a} {b} {other} {"), fields)) == "{b} B {other} {"


def test_bundle_skips_metrics_without_reference(spark):
    rows = [(1, "Text-to-SQL", "a", None), (2, "Text-to-SQL", "a", "N/A"), (3, "Text-to-SQL", "a", "b"), (4, "Unknown", "a", "b")]
    items = spark.createDataFrame(rows, "pair_id bigint, use_case string, output string, reference string")
    found = tm.bundle(items, tm.use_case_metrics(spark)).groupBy("pair_id").agg(F.array_sort(F.collect_list("metric")).alias("m"))
    assert {r["pair_id"]: r["m"] for r in found.collect()} == {
        1: ["contains", "criteria"], 2: ["contains", "criteria"], 3: ["contains", "criteria", "equals"],
    }


def test_score_rows_with_a_pattern(spark):
    pairs = spark.createDataFrame([(1, "Größe 12", None)], "pair_id bigint, output string, reference string")
    rows = tm.score_rows(pairs, {"regex": tm.regex_metric(r"\bGröße\b \d+"), "has": tm.contains_metric("größe", False)}).collect()
    assert [(r["name"], r["score"]) for r in rows] == [("regex_match", 1.0), ("contains", 1.0)]


def test_candidates_of_odd_answers(spark):
    texts = {1: '["a", "b"]', 2: '{"q": 1}', 3: "plain", 4: "[]", 5: '"text"', 6: "[1, null]"}
    rows = spark.createDataFrame(list(texts.items()), "item_id bigint, response string")
    found = {}
    for r in cd.parse_candidates(rows).orderBy("item_id", "pos").collect():
        found.setdefault(r["item_id"], []).append((r["candidate"], r["parse_code"]))
    assert found == {
        1: [("a", None), ("b", None)], 2: [(None, "not_a_list")], 3: [("plain", "json_parse_fallback")],
        4: [(None, None)], 5: [(None, "not_a_list")], 6: [("1", None), (None, None)],
    }


def test_best_is_the_first_on_ties_with_a_callers_scorer(spark):
    made = []

    def make_scorer():
        made.append(1)
        return lambda questions, candidates: (candidates.str.len() > 1).astype("float64")

    rows = [(1, 0, "q", "a"), (1, 1, "q", "bb"), (1, 2, "q", "cc"), (2, 0, "q", None)]
    pairs = spark.createDataFrame(rows, "item_id bigint, pos int, question string, candidate string")
    best = cd.best_candidate(cd.pair_scores(pairs, make_scorer)).collect()
    assert [tuple(r) for r in best] == [(1, "bb", 1.0)]
    assert pd.Series(made).empty, "the scorer is made on the workers"


def test_labels(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.9, 0.3]), (2, [1.0, 2.0]), (3, None)], "item_id bigint, logits array<double>")
    found = {r["item_id"]: (r["label"], r["error_code"]) for r in cd.label(rows).collect()}
    assert found == {1: ("neutral", None), 2: (None, "nli_shape"), 3: (None, "nli_shape")}


def test_verdict_of_odd_answers(spark):
    texts = ['{"score": 8, "reason": "ok", "more": [1]}', '{"score": "x"}', "{}", '{"score": 1', "[1]", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, response string")
    found = [r for r in judge.normalise(judge.parse_verdicts(rows)).orderBy("item_id").collect()]
    assert [r["score"] for r in found] == [0.8, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r["error_code"] for r in found] == [None, "bad_score", "no_score", "not_json", "not_json", "not_json"]
    assert found[0]["metadata"] == {"more": "[1]"} and found[0]["original_score"] == 8.0


def test_known_scale_settles_one_of_ten(spark):
    rows = spark.createDataFrame([(1.0, 10.0), (1.0, 1.0), (11.0, 10.0)], "score double, scale double")
    assert [r["score"] for r in judge.normalise(rows, "scale").collect()] == [0.1, 1.0, 1.1]


def test_model_is_retried(spark):
    def make_model():
        calls = {}

        def model(text):
            calls[text] = calls.get(text, 0) + 1
            if calls[text] < 3:
                raise RuntimeError("busy")
            return f"done after {calls[text]}"

        return model

    rows = spark.createDataFrame([(2**60 + 1, None, "p one"), (2**60 + 2, 5, "p two words")], "id bigint, n bigint, prompt string")
    answers = judge.apply_model(rows, make_model, delay=0.0, workers=2).orderBy("id").collect()
    assert [(r["id"], r["n"], r["response"], r["error_msg"], r["input_tokens"]) for r in answers] == [
        (2**60 + 1, None, "done after 3", None, 2), (2**60 + 2, 5, "done after 3", None, 3),
    ]


def test_aliases_avoid_clashes_and_reserved_words(spark):
    names = ["order_items", "other_info", "all_seasons", "a__b", "userData12", "x.orders", "orders2", "on"]
    tables = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "schema_id bigint, table_no int, table_name string")
    found = [r["alias"] for r in prompts.aliases(tables).orderBy("table_no").collect()]
    assert found == ["oi", "ot", "al", "ab", "ud12", "o", "o2", "on"]


def test_schema_text_quotes_and_notes(spark):
    rows = [("t", 0, "unit price", "REAL", "net\nprice"), ("t", 1, "id", "INTEGER", "")]
    catalog = spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type_class string, description string")
    assert prompts.table_texts(catalog).first()["ddl"] == 'CREATE TABLE t (\n  "unit price" REAL, --net price\n  id INTEGER\n);\n'


def test_shuffle_is_stable_and_whole(spark):
    rows = [(t, i, f"c{i}", "TEXT") for t in ("a", "b", "c") for i in range(6)]
    catalog = spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type_class string")
    catalog = catalog.withColumn("schema_id", F.lit(1))
    once = [tuple(r) for r in prompts.shuffle_schema(catalog, 1).collect()]
    assert sorted(once) == sorted(tuple(r) for r in prompts.shuffle_schema(catalog.repartition(7), 1).collect())
    assert {(r[2], r[4]) for r in once} == {(t, c) for t, _, c, _ in rows}
    assert sorted(once) != sorted(tuple(r) for r in prompts.shuffle_schema(catalog, 2).collect())


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [0.5, 0.5, 9.0], [5.0, -1.0, 0.25, 0.25, 7.0, 0.3]])
def test_median(spark, values):
    scores = spark.createDataFrame([(1, v) for v in values] + [(1, None)], "g int, score double")
    found = summary.score_stats(scores, ["g"]).first()
    assert found["median_score"] == pd.Series(values).median() and found["n"] == len(values)


def test_rates_of_an_empty_run(spark):
    empty = spark.createDataFrame([("r", 0, 0, 0, 0, 0)], "model string, processed bigint, correct bigint, exact bigint, generation_errors bigint, execution_errors bigint")
    assert summary.run_rates(empty).first()["accuracy"] == 0.0


def test_history_without_some_columns(spark):
    found = summary.history_summary(spark.createDataFrame([("a", " "), ("a", "x"), ("a", None)], "run string, generation_error_msg string")).first()
    assert (found["processed"], found["correct"], found["generation_errors"], found["avg_latency_s"]) == (3, 0, 1, 0.0)


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ('{"a": 1, "a": 2}', 1.0), ('[{"a": 1, "a": {"b": 1, "b": 2}}]', 1.0), ('{"a": ": \\"a\\":", "a": []}', 1.0), ('{"a": 1 "a": 2}', 0.0),
        ('{"a": 1, "a"}', 0.0), ('{"a": 1, "a": 2} x', 0.0), ('{"a", "a": 1}', 0.0), ('{"a": 1, "a: 2}', 0.0), ('{"\\x": 1, "\\x": 2}', 0.0), ('"a": 1, "a": 2', 0.0),
    ],
)
@pytest.mark.parametrize("allowed", ["true", "false"])
def test_repeated_keys_are_json(spark, text, valid, allowed):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    try:
        assert one(spark, tx.json_score(F.lit(text))) == valid
        rows = spark.createDataFrame([(text,)], "t string")  # read, not folded
        assert rows.select(tx.json_score(F.col("t")).alias("x")).first()["x"] == valid
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_the_last_of_repeated_keys_counts(spark):
    from sqlassay.operators import candidates, judge

    rows = spark.createDataFrame([('{"score": 1, "reason": "a", "x": "1", "score": 0.5, "x": "2", "reason": "b"}',)], "response string")
    (r,) = judge.parse_verdicts(rows).collect()
    assert (r["score"], r["reason"], r["metadata"], r["error_code"]) == (0.5, "b", {"x": "2"}, None)
    lists = spark.createDataFrame([('{"q": 1, "q": 2}',), ('[{"q": 1, "q": 2}]',), ("[1, ",)], "response string")
    assert [r["parse_code"] for r in candidates.with_candidates(lists).collect()] == [candidates.NOT_A_LIST, None, candidates.FALLBACK]


def edited(text, edits, rng):
    letters = list(text)
    for _ in range(edits):
        k = rng.randrange(len(letters))
        rng.choice([lambda: letters.insert(k, "#"), lambda: letters.pop(k), lambda: letters.__setitem__(k, "%")])()
    return "".join(letters)


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("short", [8, tx.SHORT])
def test_distances_in_doubling_bands_are_exact(spark, short, monkeypatch):
    monkeypatch.setattr(tx, "SHORT", short)
    rng = random.Random(4)
    texts = []
    for size in (1, 63, 64, 65, 66, 130, 300):
        for edits in (0, 1, 20, 64, 65, 140):
            a = "".join(rng.choice("abé😀") for _ in range(size))
            texts.append((a, edited(a + "x" * 3, min(edits, size), rng)))
        texts.append(("".join(rng.choice("ab") for _ in range(size)), "".join(rng.choice("cd") for _ in range(size * 2))))
    texts += [("", "x" * 200), ("x" * 200, "")]
    df = spark.createDataFrame(texts, "a string, b string")
    found = df.select("a", "b", tx.levenshtein_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == distance_by_hand(r["a"], r["b"]) for r in found)


def test_long_texts_a_few_edits_apart(spark):
    import time

    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    b = list(a)
    for k in range(1000, 20_000, 2000):
        b[k] = "#"
    df = spark.createDataFrame([(a, "".join(b))], "a string, b string")
    start = time.monotonic()
    assert df.select(tx.levenshtein_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] == 10
    assert time.monotonic() - start < 30


@pytest.mark.parametrize("few", [0, 40])
@pytest.mark.parametrize("name", ["wide", "equal", "skewed", "signed", "odd"])
def test_medians_of_groups_at_any_scale(spark, name, few, monkeypatch):
    monkeypatch.setattr(summary, "FEW", few)
    rng = random.Random(name)
    values = {
        "wide": [rng.random() * 1e6 for _ in range(3001)],
        "equal": [0.25] * 4000 + [1.0] * 3999,
        "skewed": [10.0 ** rng.uniform(-9, 9) for _ in range(501)],
        "signed": [rng.choice([-1.0, 1.0]) * 1.7e308 * rng.random() for _ in range(400)],
        "odd": [float("nan")] * 5 + [1.0, 2.0, None],
    }[name]
    groups = {None: values, 1: values[::2], 2: [3.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, score double")
    found = {r["g"]: r["median_score"] for r in summary.exact_median(df, ["g"], bins=64).collect()}
    for g, vs in groups.items():
        vs = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
        want = (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2 if abs(vs[len(vs) // 2]) < 1e300 else None
        assert want is None or found[g] == want or (want != want and found[g] != found[g]), (g, found[g], want)
    assert {r["g"]: r["n"] for r in summary.score_stats(df, ["g"]).collect()} == {g: sum(v is not None for v in vs) for g, vs in groups.items()}


def test_no_scores_no_median(spark):
    df = spark.createDataFrame([(1, None)], "g int, score double")
    assert summary.exact_median(df, ["g"]).collect() == []


def test_model_for_several_prompts_at_once(spark):
    from sqlassay.operators.judge import apply_model

    def make():
        asked = {}

        def model(prompts):
            assert len(prompts) <= 3
            for p in prompts:
                asked[p] = asked.get(p, 0) + 1
            if "broken" in prompts and len(prompts) > 1:
                raise RuntimeError("no answer")
            return [None if p == "broken" or (p == "late" and asked[p] < 2) else f"{p} {asked[p]}" for p in prompts]

        return model

    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "late", "b", "c", "c", "d"])], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["response"], r["error_msg"]) for r in apply_model(rows, make, delay=0.0, together=3).collect()}
    assert got[1] == ("late 2", None) and got[0] == ("a 1", None) and got[2] == ("b 1", None) and all(e is None for _, e in got.values())
    rows = spark.createDataFrame([(0, "broken")], "id int, prompt string")
    got = apply_model(rows, make, delay=0.0, together=3).first()
    assert (got["response"], got["error_msg"]) == ("", "Generation failed after 3 attempts: the model returned nothing")
    short = apply_model(rows, lambda: lambda prompts: [], tries=1, together=3).first()
    assert short["error_msg"] == "Generation failed after 1 attempts: the model returned 0 answers for 1 prompts"
    assert apply_model(rows.limit(0), make, together=3).collect() == []
