"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint is a 64-bit SimHash of the text's four-word shingles. For a radius r every bit
gets a non-zero vector of r + 1 bits; table t (a non-zero vector again) keeps the bits whose
product with t is odd. However r or fewer differing bits are chosen, some t is orthogonal
to all their vectors, so that table hides them all and the two fingerprints collide there:
2^(r+1) - 1 tables find *every* pair within the radius, with no chance of a miss.

Fingerprints are summed by built-in functions, one row a shingle (Spark's ``xxhash64`` is XXH64 with seed 42), so no Python
process holds texts beside the JVM. Equal fingerprints are merged before anything is compared, so thousands of copies are one
member. Links are found bucket by bucket (``components.linked_in_buckets``).

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is
linked like any other; rows that repeat a doc_id are compared each by its own text; a null
doc_id is linked like any other but is a component's id only where all are null; an empty
table gives an empty result; of other columns only the kept rows' values are passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.llm.components import linked_in_buckets
from sqlassay.session import landed

SHINGLE, RADIUS = 4, 4
_BLANKS, _UPPER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def masks(radius: int, bits: int = 64, step: int = 1) -> list[int]:
    """The tables' masks, as signed integers. Another ``step`` (odd, no multiple of the number of masks) deals the bits anew."""
    vectors = [i * step % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    tables = [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() & 1) for t in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in tables]


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null for a text without any."""
    # Translating costs far more than lower(), which changes other letters too.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    trimmed = F.btrim(lower, F.lit(_BLANKS))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a digest of the text) and fp (signed) of each row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    own = ["row", "doc_id", "text_key"]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "words")
    rows = rows.select(*own, "words", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))).alias("at"))
    shingle = F.concat_ws(" ", *[F.get("words", F.col("at") + k) for k in range(SHINGLE)])  # past the end is null, which joins as nothing
    hashes = rows.select(*own, F.when(F.col("words").isNotNull(), F.xxhash64(shingle)).alias("h"))
    # Bits k and k + 32 are counted in the halves of one integer: a text has fewer than 2^31 shingles.
    pair = lambda k: F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1 << 32 | 1))
    sums = hashes.groupBy(*own).agg(F.count("h").alias("n"), *[F.sum(pair(k)).alias(f"s{k}") for k in range(32)])
    half = F.lit((1 << 32) - 1)
    ones = [F.col(f"s{k}").bitwiseAND(half) for k in range(32)] + [F.shiftrightunsigned(f"s{k}", 32) for k in range(32)]
    bits = [F.when(one * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, one in enumerate(ones)]
    return sums.select("doc_id", "text_key", reduce(Column.bitwiseOR, bits).alias("fp"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for the fingerprints of ``prints`` (fp) that have another within ``radius`` bits, directly or in steps."""
    nodes = prints.select("fp").distinct()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("mask")) for t, m in enumerate(masks(radius))])
    rows = nodes.select("fp", F.inline(tables)).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), F.col("fp").alias("id"))
    shared = rows.groupBy("t", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    shared = shared.select(F.col("t").alias("_t"), F.bitwise_not("key").alias("_key"))  # see components.apart
    # Spark sizes the exploded rows as if each were still one, 31 times too low, and would broadcast all of them by way of the driver.
    members = rows.hint("merge").join(shared, (rows["t"] == shared["_t"]) & (F.bitwise_not(rows["key"]) == shared["_key"]))
    members = landed(members.select(F.struct("t", "key").alias("bucket"), "id"), "members")
    near = lambda one, other: F.bit_count(one["id"].bitwiseXOR(other["id"])) <= radius
    again = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("mask")) for t, m in enumerate(masks(radius, step=11))])

    def finer(rows: DataFrame) -> DataFrame:
        """Buckets of a second family, dealt otherwise: it covers every pair too and splits what agrees on a mask of the first."""
        rows = rows.drop("bucket").distinct()
        cut = rows.select(*rows.columns, F.inline(again))
        return cut.select(F.struct("t", F.col("id").bitwiseAND(F.col("mask")).alias("key")).alias("bucket"), *rows.columns)

    return linked_in_buckets(members, lambda pairs: pairs, may=near, finer=finer)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, root (smallest fingerprint of the component) and component_id."""
    prints = landed(fingerprints(docs), "fingerprints")
    return _with_components(prints, radius)


def _with_components(prints: DataFrame, radius: int) -> DataFrame:
    # Per fingerprint first, so that the copies of one text meet as one row.
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = links(prints, radius)
    linked = least.join(roots, least["fp"] == roots["node"]).select("fp", "least", "root")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = landed(linked.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "linked")
    classes = least.join(linked, least["fp"] == linked["_fp"], "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(landed(classes, "classes"), "fp")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each component stays: the smallest doc_id."""
    whole = F.struct(*docs.columns).alias("_row")
    prints = landed(fingerprints(docs), "fingerprints")
    stay = _with_components(prints, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A document repeated within its component counts once: one text of it stays.
    stay = stay.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_key")).alias("one"), F.count(F.lit(1)).alias("n"))
    stay = landed(stay.select("root", "n", F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_key")), "stay")
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_print"), whole)
    kept = rows.join(stay, rows["_doc"].eqNullSafe(stay["_id"]) & (rows["_print"] == stay["_key"]))
    once = kept if stay.filter("n > 1").isEmpty() else kept.dropDuplicates(["root"])
    return once.select("_row.*")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
