"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and pairs of words are hashed into a fixed number of buckets. The raw model counts
them over *all* documents, the target model over labelled good ones; a document's log
weight is the sum over its n-grams of log target / raw, its score the mean passed through a
logistic curve. Sampling adds Gumbel noise (a function of seed and doc_id) to the log weight
and keeps the k largest, which draws k documents without replacement in proportion to their
weights. The k-th largest is found exactly by radix selection: four counts over 65,536
buckets, never a sort of all rows.

Bounded by a documented parameter: the labelled documents that are read (``SAMPLE`` per
label, those with the smallest hash of doc_id outside the held-out third). Their text is
reached by a broadcast of that many ids; model and counts are ``2 * BUCKETS`` numbers.

Defined cases: a null text has no n-grams, like an empty one: weight 0 and score 0.5 of the
curve's middle; texts are read in pieces of about ``PIECE`` characters, cut at white space; rows that share a doc_id share
their noise; rows equal to the k-th are all sampled; without labels of both kinds the raw model is the target
too and everything is kept; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, DoubleType

from sqlassay.llm.toxicity import held_out
from sqlassay.session import landed

BUCKETS = 1 << 14
SAMPLE = 8000
SHARE = 0.5
PIECE = 1 << 20
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of a token; forgets when full."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        # Capitals are a mark of their own beside the word.
        shout = len(token) > 1 and token.isupper()
        value = zlib.crc32((("^" if shout else "") + token.lower()).encode())
        self[token] = value
        return value


def buckets_of(text: str | None, hashes: dict, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's words, then pairs, piece by piece; a word next to itself is one pair for all words."""
    last = None

    def flush(tokens: list[int], last: int | None) -> np.ndarray:
        h = np.array(tokens if last is None else [last, *tokens], dtype=np.uint64)
        pairs = (h[:-1] * _MIX) ^ (h[1:] + (h[:-1] << np.uint64(7)))
        pairs[h[:-1] == h[1:]] = np.uint64(1)
        own = h if last is None else h[1:]
        mixed = np.concatenate([own * _MIX, (pairs + np.uint64(1)) * _MIX])
        return ((mixed >> np.uint64(40)) % np.uint64(size)).astype(np.int64)

    text = text or ""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, min(start + PIECE, len(text)))
        end = space.start() if space else len(text)
        tokens = list(map(hashes.__getitem__, _TOKEN.findall(text, start, end)))
        if tokens:
            yield flush(tokens, last)
            last = tokens[-1]
        start = max(end, start + 1)


def counts(docs: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(size, dtype=np.int64), _Hashes()
        for batch in batches:
            for text in batch["text"]:
                for found in buckets_of(text, hashes, size):
                    total += np.bincount(found, minlength=size)
        filled = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": filled, "n": total[filled]})

    schema = StructType([StructField("bucket", LongType()), StructField("n", LongType())])
    rows = docs.select("text").mapInPandas(counted, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, dtype=np.int64)
    for row in rows:
        total[row["bucket"]] = row["n"]
    return total


def labelled(docs: DataFrame, labels: DataFrame, quality: int, sample: int = SAMPLE) -> DataFrame:
    """Texts of at most ``sample`` documents with this label, outside the held-out third."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    ids = usable.filter(f"low = {quality} AND high = {quality}").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")


class Model:
    """Log ratios per bucket and the mean ratio that splits good from bad."""

    def __init__(self, ratios: np.ndarray, middle: float = 0.0, scale: float = 1.0):
        self.ratios, self.middle, self.scale = ratios, middle, scale


def _weights(model: Model):
    schema = StructType([StructField("total", DoubleType()), StructField("n", LongType())])

    @F.pandas_udf(schema)
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, size = _Hashes(), len(model.ratios)
        for texts in batches:
            rows = []
            for text in texts:
                total, n = 0.0, 0
                for found in buckets_of(text, hashes, size):
                    total, n = total + float(model.ratios[found].sum()), n + len(found)
                rows.append((round(total, 6), n))
            yield pd.DataFrame(rows, columns=["total", "n"]).astype({"total": "float64", "n": "int64"})

    return weighed


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = BUCKETS) -> Model:
    """Raw model of all ``docs``, target model of the labelled good ones, threshold from labelled ones of both kinds."""
    good = labelled(docs, labels, 1, sample)
    target = counts(good, size)
    if not target.sum():
        return Model(np.zeros(size))
    raw = counts(docs, size)
    smooth = lambda n: np.log((n + 1.0) / (n.sum() + size))
    model = Model(np.round(smooth(target) - smooth(raw), 6))
    weigh = _weights(model)
    means = [[row[0] for row in rows.select(weigh(F.col("text")).alias("w")).filter("w.n > 0").select(F.expr("w.total / w.n")).collect()] for rows in (good, labelled(docs, labels, 0, sample))]  # at most 2 * sample numbers
    if all(means):
        model.middle, model.scale = _split(means[0], means[1])
    else:
        model.middle, model.scale = min(means[0]) - 1.0, 1.0
    return model


def _split(good: list[float], bad: list[float]) -> tuple[float, float]:
    """The mean ratio with the least sum of the two error rates, and the spread around it."""
    values = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    lost, passed = 0.0, 1.0
    best, at = passed, values[0][0] - 1e-6
    for k, (value, is_good) in enumerate(values):
        lost, passed = lost + is_good / len(good), passed - (1 - is_good) / len(bad)
        following = values[k + 1][0] if k + 1 < len(values) else value + 1e-6
        if following > value and lost + passed < best:
            best, at = lost + passed, (value + following) / 2
    return at, max(1e-6, float(np.std([x for x, _ in values])) / 4)


def weights(docs: DataFrame, model: Model, seed: int = 42) -> DataFrame:
    """doc_id, held_out, log_weight, score, kept and gumbel_key of each row of ``docs``."""
    rows = docs.select("doc_id", _weights(model)(F.col("text")).alias("w"))
    mean = F.when(F.col("w.n") > 0, F.col("w.total") / F.col("w.n")).otherwise(model.middle)
    curve = 1 / (1 + F.exp(-(F.col("mean") - model.middle) / model.scale))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.select("doc_id", held_out().alias("held_out"), F.col("w.total").alias("log_weight"), mean.alias("mean"), (-F.log(-F.log(uniform))).alias("noise"))
    return rows.select("doc_id", "held_out", F.round(curve, 6).alias("score"), (F.col("mean") >= model.middle).alias("kept"), "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key"))


def sortable(value: Column) -> Column:
    """A bigint in the order of the doubles (micro-units, saturated at the ends)."""
    return F.round(value * 1e6).cast("bigint")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column: four counts of at most 65,536 groups each; None when there are fewer rows."""
    flipped = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix = 0
    for shift in (48, 32, 16, 0):
        known = rows if shift == 48 else rows.filter(F.shiftrightunsigned(flipped, shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(0xFFFF))
        for row in sorted(known.groupBy(digit.alias("digit")).count().collect(), key=lambda r: -r["digit"]):
            if k <= row["count"]:
                prefix = (prefix << 16) | row["digit"]
                break
            k -= row["count"]
        else:
            return None
    return prefix - (1 << 63)


def resample(docs: DataFrame, model: Model, share: float = SHARE, seed: int = 42) -> DataFrame:
    """``weights`` with ``sampled``: the ceil(share * rows) largest keys."""
    rows = landed(weights(docs, model, seed).withColumn("_key", sortable(F.col("gumbel_key"))), "weights")
    cut = kth_largest(rows, "_key", math.ceil(share * rows.count()))
    return rows.withColumn("sampled", F.lit(False) if cut is None else F.col("_key") >= cut).drop("_key")
