"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from sqlassay.plans.fixtures import TABLES
from tools.check import plain

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# The training-data operators, where they are installed, have tests of their own.
NAMES = sorted(name for name in QUERIES if name[0].isupper())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in rows)
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())
    assert ours == theirs


def test_entry_runs(spark):
    found = entry_module.entry(spark)
    assert found.columns == ["case_id", "exact_match", "correct", "error_db_exec"]
    assert found.count() > 0


def test_core_queries_need_no_optional_package():
    """Without the packages that only the training-data operators import, all other queries are there."""
    import pathlib
    import subprocess
    import sys

    hide = "import sys; [sys.modules.__setitem__(n, None) for n in ('xxhash', 'ahocorasick', 'sentencepiece', 'regex', 'corpus_pipeline')]; "
    ask = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(n for n in e.queries() if n[0].isupper()), len(e.queries()))"
    root = pathlib.Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", hide + ask], capture_output=True, text=True, cwd=root)
    assert out.stdout.split() == ["True", str(len(NAMES))], out.stderr
