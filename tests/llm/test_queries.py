"""The numbered queries and the pipeline over the given tables."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from sqlassay.functions.rows import exploded  # noqa: F401  the helper the operators share
from sqlassay.llm import rules, toxicity
from sqlassay.llm.registry import ORACLES, QUERIES
from sqlassay.session import landed
from tests.llm import test_dedup as by_hand
from tests.llm.test_text_operators import WORD
from tools.check import plain

FOLDER = "/root/testdata/sf0.001"


def test_a_query_per_operator():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    names = sorted(d[0] for d in cursor.description)
    assert sorted(df.columns) == names
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    assert sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == sorted(repr(tuple(plain(r[k]) for k in at)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    table = "conversations" if name.startswith("op10") else "documents"
    key = "conv_id" if table == "conversations" else "doc_id"
    docs = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    found = QUERIES[name](spark, FOLDER)
    assert {r[0] for r in found.select(key).distinct().collect()} == {r[0] for r in docs.select(key).distinct().collect()}


def test_native_operators_run_no_python(spark):
    for name in ("op3_quality_rules", "op4_exact_dedup", "op7_line_dedup"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, landed(stage(spark, docs, FOLDER), "stage"))
        docs = steps[name][1]
    rows = {name: ([tuple(r) for r in before.collect()], after) for name, (before, after) in steps.items()}

    before, after = rows["toxicity"]
    lexicon = toxicity.learn(steps["toxicity"][0], labels)
    built = lexicon.automaton()
    score = lambda e: e / (e + lexicon.pivot * 3 / 7)
    assert sorted(tuple(r) for r in after.collect()) == sorted(r for r in before if not lexicon.entries or score(toxicity.evidence(r[1], built)) < 0.7)

    before, after = rows["quality rules"]
    kept = {r["doc_id"] for r in rules.verdicts(rules.ledger(steps["quality rules"][0])).filter("kept").collect()}
    assert sorted(tuple(r) for r in after.collect()) == sorted(r for r in before if r[0] in kept)

    before, after = rows["line dedup"]
    gone = {(i, k) for i, k, a, b in by_hand.lines_by_hand([r[:2] for r in before]) if (i, k) != (a, b)}
    want = sorted((r[0], "\n".join(line for k, line in enumerate(r[1].split("\n")) if (r[0], k) not in gone), *r[2:]) for r in before)
    assert sorted(tuple(r) for r in after.collect()) == want

    before, after = rows["SimHash near-dedup"]
    stay = {c for _, _, c in by_hand.near_by_hand([r[:2] for r in before])}
    assert sorted(tuple(r) for r in after.collect()) == sorted(r for r in before if r[0] in stay)

    before, after = rows["best-fit packing"]
    lengths = {}
    for r in after.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r[0]: len(WORD.findall(r[1])) for r in before}
    assert all(after.columns == columns for name, (_, after) in rows.items() if name != "best-fit packing")


def test_pipeline_on_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []
