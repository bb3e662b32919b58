"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms (NFKC), case, invisible characters, Cyrillic and
Greek letters that look Latin, and digits or signs that stand for letters. Lexicon entries
are word beginnings. All are found in one pass of an automaton; a hit counts only at the
start of a word, and not inside an exception phrase. A document's evidence is the sum
of its hits' weights over the logarithm of its length in words.

``learn`` gets the entries from labelled rows: for every word the number of different
neighbours it has in toxic and in other texts (so that copies of one text count once), summed
over word beginnings. A beginning is an entry if its odds are high beyond chance and no
longer beginning explains it. The labelled rows it reads are bounded by ``SAMPLE``, those
with the smallest hash of doc_id; everything else covers all rows.

Defined cases: a null text is scored like an empty one, 0; whole texts are folded and scanned,
however long; rows are judged one by one; rows
without a label, or labelled twice with both values, teach nothing; without toxic labels the
lexicon is ``SEED``; an empty table gives an empty result; a null doc_id is scored and never
learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType
from pyspark.storagelevel import StorageLevel

from sqlassay.functions.rows import exploded

#: Labelled rows that are learned from, at most, per label.
SAMPLE = 8000
#: Entries of a learned lexicon, at most; exception phrases, at most.
ENTRIES, EXCEPTIONS = 2000, 2000
SHORTEST, LONGEST = 4, 12
THRESHOLD = 0.7
#: Used where there are no labels to learn from.
SEED = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "loser": 3.0, "scum": 4.0, "worthless": 3.0, "pathetic": 3.0, "disgusting": 3.0}

# Characters that are read as a Latin letter. The letters i and l are one class, as 1 stands for both.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "i", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
}
_TABLE = str.maketrans(_LOOKS)
_SIGNS = str.maketrans("@$!|+", "asiit")
_SIGN_INSIDE = re.compile(r"(?<=[^\W_])[@$!|+](?=[^\W_])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """The text as it is matched."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower().translate(_TABLE)
    return _SIGN_INSIDE.sub(lambda sign: sign[0].translate(_SIGNS), text)


@dataclass
class Lexicon:
    """Word beginnings with weights, phrases that excuse a hit, and the evidence that scores 0.7."""

    entries: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    pivot: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for phrase in self.exceptions:
            built.add_word(phrase, (0, phrase, 0.0))
        for entry, weight in self.entries.items():  # an entry wins over an equal phrase
            built.add_word(entry, (1, entry, weight))
        built.make_automaton()
        return built


def _boundary(text: str, at: int) -> bool:
    return not 0 <= at < len(text) or not text[at].isalnum()


def evidence(text: str | None, automaton: ahocorasick.Automaton) -> float:
    """Sum of weights of the hits in one text over the logarithm of its words."""
    if not text or not automaton:
        return 0.0
    text = folded(text)
    excused, hits = [], []
    for end, (is_entry, word, weight) in automaton.iter(text):
        start = end - len(word) + 1
        if not _boundary(text, start - 1):
            continue
        if is_entry:
            hits.append((start, weight))
        elif _boundary(text, end + 1):
            excused.append((start, end))
    if not hits:
        return 0.0
    reach = -1
    spans = iter(sorted(excused))
    span = next(spans, None)
    total, last = 0.0, -1
    for start, weight in sorted(hits, key=lambda hit: (hit[0], -hit[1])):
        while span and span[0] <= start:
            reach, span = max(reach, span[1]), next(spans, None)
        if start > reach and start != last:  # one hit per word, the heaviest
            total, last = total + weight, start
    return total / math.log(math.e + len(text.split()))


def _scorer(lexicon: Lexicon):
    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            yield pd.Series([evidence(text, automaton) for text in texts], dtype="float64")

    return scored


def evidence_column(lexicon: Lexicon, text: str = "text") -> Column:
    return _scorer(lexicon)(F.col(text)) if lexicon.entries else F.lit(0.0)


def score_of(found: Column, lexicon: Lexicon) -> Column:
    """0 to 1; the pivot's evidence scores the threshold."""
    return found / (found + F.lit(lexicon.pivot * (1 - THRESHOLD) / THRESHOLD))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the labelled rows that may be learned from, at most ``sample`` per label."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(sample))
    # At most 2 * sample rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


@F.pandas_udf(ArrayType(StringType()))
def _neighbours(texts: pd.Series) -> pd.Series:
    """'previous word' pairs of the folded text, each once."""

    def pairs(text: str | None) -> list[str]:
        words = _WORD.findall(folded(text or ""))
        return list({f"{a} {b}" for a, b in zip(["", *words], words)})

    return texts.map(pairs)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled rows outside the held-out third."""
    # Both are read several times; on disk they take no room in the memory of executors, whose Python workers need it.
    rows = training_rows(docs, labels, sample).persist(StorageLevel.DISK_ONLY)
    pairs = exploded(rows, ["toxic"], _neighbours(F.col("text")), "pair").groupBy("pair").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
    pairs = pairs.select("pair", F.substring_index("pair", " ", -1).alias("word"), "toxic", "least").persist(StorageLevel.DISK_ONLY)
    try:
        if rows.filter("toxic = 1").isEmpty():
            return Lexicon({folded(word): weight for word, weight in SEED.items()})
        words = pairs.groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("bigint")).alias("bad"), F.sum((F.col("least") == 0).cast("bigint")).alias("good"))
        sizes = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
        base = sizes["bad"] / (sizes["bad"] + sizes["good"])
        counted = words.select("bad", "good", F.explode(F.expr(f"transform(sequence({SHORTEST}, greatest({SHORTEST}, least({LONGEST}, length(word)))), n -> left(word, n))")).alias("start")).filter(f"length(start) >= {SHORTEST}")
        counted = counted.groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        # By chance a start with n contexts is toxic in all of them with probability base^n; below 1e-9 for any number of starts that matters.
        least = max(5, math.ceil(9 / max(0.3, -math.log10(base))))
        strong = counted.filter(f"bad >= {least} AND bad >= 50 * good * {base / (1 - base)}")
        found = {row["start"]: (row["bad"], row["good"]) for row in strong.orderBy(F.desc("bad"), "start").limit(8 * ENTRIES).collect()}
        chosen = sorted(_stems(found), key=lambda start: (-found[start][0], start))[:ENTRIES]
        weight = lambda start: math.log((found[start][0] + 0.5) / (sizes["bad"] + 1)) - math.log((found[start][1] + 0.5) / (sizes["good"] + 1))
        lexicon = Lexicon({start: round(weight(start), 3) for start in chosen})
        if lexicon.entries:
            hit = F.lit(False)
            for size in sorted({len(start) for start in chosen}):
                hit = hit | F.substring("word", 1, size).isin([start for start in chosen if len(start) == size])
            phrases = pairs.filter(hit).filter("toxic = 0 AND pair NOT LIKE ' %'").orderBy("pair").limit(EXCEPTIONS)
            lexicon.exceptions = {row["pair"] for row in phrases.collect()}
            lexicon.pivot = _pivot([tuple(row) for row in rows.select(evidence_column(lexicon), "toxic").collect()])
        return lexicon
    finally:
        pairs.unpersist()
        rows.unpersist()


def _stems(found: dict[str, tuple[int, int]]) -> list[str]:
    """Beginnings that no longer beginning explains and that add to their own beginning."""
    longer = {}
    for start, (bad, _) in found.items():
        longer[start[:-1]] = max(longer.get(start[:-1], 0), bad)
    ends = [s for s, (bad, _) in found.items() if longer.get(s, 0) < 0.9 * bad]
    return [s for s in ends if not any(s[:n] in set(ends) for n in range(SHORTEST, len(s)))]


def _pivot(scored: list[tuple[float, int]]) -> float:
    """The evidence that splits the sample (at most 2 * SAMPLE rows) with the fewest errors; the middle of the best gap."""
    values = sorted(scored)
    wrong = sum(1 for value, toxic in values if not toxic)
    best, at = None, 1.0
    for k, (value, toxic) in enumerate(values):
        below = values[k - 1][0] if k else 0.0
        if value > below and (best is None or wrong < best):
            best, at = wrong, (value + below) / 2
        wrong += 1 if toxic else -1
    return max(at, 1e-6)


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted and evidence."""
    rows = docs.select("doc_id", evidence_column(lexicon).alias("evidence"))
    rows = rows.select("doc_id", held_out().alias("held_out"), score_of(F.col("evidence"), lexicon).alias("score"), "evidence")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def clean_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), evidence_column(lexicon).alias("_found"))
    return rows.filter(score_of(F.col("_found"), lexicon) < THRESHOLD).select("_row.*")
