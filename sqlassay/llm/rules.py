"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one
integer whose bit *b* is set when rule *b* fails. A policy is a named, versioned set of
rules, that is a mask; a verdict is ``failed & mask = 0``. Changing a policy, comparing
policies and asking what each rule removes on its own need the ledger only, never the text.

All of it is built-in functions inside one row: no shuffle, so no hot key.

Defined cases: a null text has no words, like an empty one, and fails ``few_words``; very
long texts take time in proportion to n log n of their words; rows are judged one by one,
so repeated rows repeat their verdicts; an empty table gives an empty ledger; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions.rows import exploded, let

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5

#: Rule number = bit. A rule is the condition of *failing*, on the measurements.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    ("capitals", lambda: 100 * F.col("n_capitals") > 30 * F.col("word_chars")),
]
BIT = {name: 1 << bit for bit, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, Sequence[str]] = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "repeated_lines"),
    "prose-2": tuple(BIT),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def mask_of(policy: str | Sequence[str]) -> int:
    """The mask of a policy's name or of a list of rules."""
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else set(policy)))


def _long(column: Column) -> Column:
    return column.cast("bigint")


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text holds twice or more."""
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " ")))

    def starts(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda text, i: F.struct(text.alias("text"), i.alias("at"))))

        def twins(rows: Column) -> Column:
            near = lambda row, other: F.coalesce(row["text"] == F.get(rows, other)["text"], F.lit(False))
            return F.sort_array(F.transform(F.filter(rows, lambda row, j: near(row, j - 1) | near(row, j + 1)), lambda row: row["at"]))

        return let(ordered, twins)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda start, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - start, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    return let(windows, lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), let(starts(found), covered)).otherwise(0))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and the measurements of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        "doc_id", *keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    only = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    return cut.select(
        "doc_id", *keep,
        _long(F.size("_words")).alias("n_words"),
        _long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        _long(only("[^#*$%&|<>]+")).alias("n_symbols"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.coalesce(_long(_repeat_words(F.col("_words"))), _long(F.lit(0))).alias("n_repeat_words"),
        _long(F.size("_lines")).alias("n_lines"),
        _long(only(r"[^\p{Lu}]+")).alias("n_capitals"),
    )


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep``, the measurements and ``failed``, one bit per rule. Store it to judge again later."""
    bits = [F.when(fails(), F.lit(1 << bit)).otherwise(0) for bit, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs, *keep).withColumn("failed", _long(failed))


def _passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask)) == 0


def verdicts(rows: DataFrame, policy: str | Sequence[str] = "prose-2") -> DataFrame:
    """Ledger rows with ``base_failed`` and the policy's ``kept``; what fails the base is never kept."""
    base = mask_of(BASE)
    return rows.withColumn("base_failed", ~_passes(base)).withColumn("kept", _passes(mask_of(policy) | base))


def ablations(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per policy and rule: how many documents fail it, and how many only it removes.

    Documents are first counted per ``failed`` value, of which there are few.
    """
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(*[
        F.struct(F.lit(name).alias("policy"), F.lit(mask_of(list(rules))).cast("bigint").alias("mask"), F.lit(rule).alias("rule"), F.lit(BIT[rule]).cast("bigint").alias("bit"))
        for name, rules in policies.items() for rule in rules
    ])
    each = counts.select("failed", "n", F.inline(asked))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), _long(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(hit == F.col("bit")).alias("n_only"), count(hit == 0).alias("n_kept")
    )


def kept_documents(docs: DataFrame, policy: str | Sequence[str] = "prose-2") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps."""
    whole = F.struct(*docs.columns).alias("_row")
    rows = docs.select(F.col("doc_id"), F.col("text"), whole)
    judged = verdicts(ledger(rows, "_row"), policy)
    # A filter on the verdict would be pushed below the measurements and compute them anew for each of its terms.
    return exploded(judged, [], F.array(F.when(F.col("kept"), F.col("_row"))), "_row").select("_row.*")
