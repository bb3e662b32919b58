from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, fp string, bucket string, name string, _row string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "k", "s", "f", "b", "n", "r") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice(["ta", "lo", "mi", "sen", "un", "ek", "or", "pa"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def make(n, seed):
        pick = random.Random(seed)
        return " ".join(pick.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward(spark, prose):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, letters beyond ASCII."""
    text = prose(40, 1)
    rows = [
        (1, text, "a"), (2, text, "a"), (3, None, "a"), (4, "", None), (5, "  \n\t\n", "b"), (None, "no id here", "b"), (None, text, None),
        (6, "same row", "c"), (6, "same row", "c"), (6, "same id, other text", "c"), (7, prose(30000, 2), "a"), (8, "Ünïcode ÄÖÜ \U0001F600 中文", "b"), (9, text + "x", "a"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


def read(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
