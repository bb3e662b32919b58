"""Cross-tokenizer alignment on Arrow tables.

Two vocabularies cut the same bytes. Per portion of documents both lists of tokens are
flattened with their parents' indices; a cumulative sum of token sizes, started anew in each document, gives each token's
end, and (document, end) is the key on which both sides meet in a hash join. Keys on both sides end a
group. Between two neighbouring keys lies one pair of overlapping tokens, so the rows
of the full join, sorted and filled backwards, are the links.

How many documents hold a pair of ids is counted by ``Table.group_by`` in the task and summed by Spark. The
counts are then looked up per document: pairs held by so many documents that at most ``FREQUENT`` pairs
are held by more come as one sorted array, of bounded size, to every task; all other pairs, none of which is frequent,
meet their counts in a join. No pair is left out either way.

Memory: portions of ``PORTION`` bytes of text, or one longer document; partial counts of ``HELD`` pairs; words met before.

Defined cases: a null or empty text, and one that either vocabulary does not give back byte by byte,
has no tokens and counts nowhere; a text of any length is aligned whole; special tokens' strings are plain text; each row is a
document of its own, also where rows repeat; an empty table gives an empty result; other columns are passed on by
``aligned``, and a column with the name of a result is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sqlassay.llm import merge_automaton
from sqlassay.llm.pieces import Normaliser
from sqlassay.session import landed

BYTES_MODEL, PIECES_MODEL = merge_automaton.MODEL, "/opt/tokenizers/piece_bpe_32k.model"
PORTION, HELD, FREQUENT = 1 << 20, 1 << 20, 1 << 20
MARK = "▁"
#: Characters of a text that go to the piece tokenizer at a time, where it is not read word by word; a cut is made at single blanks only.
_STRETCH = 1 << 18
#: Bytes of remembered words.
CACHE = 64 << 20
#: Single blanks, where a text may be cut: no piece reaches across one (checked), and runs of blanks stay whole.
_SINGLE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Side:
    """A vocabulary: how it encodes and the bytes of each of its tokens."""

    def __init__(self, encode, labels: list[bytes]):
        self.encode = encode
        self.labels = pa.array(labels, pa.binary())
        self.sizes = np.array([len(label) for label in labels], dtype=np.int64)


def stretches(text: str, size: int = _STRETCH) -> list[str]:
    """The text cut at single blanks, which are left out: the tokenizer puts one before each stretch."""
    found, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1] == " " or text[cut + 1 : cut + 2] in ("", " ")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        found.append(text[at:cut])
        at = cut + 1
    return [*found, text[at:]]


def words(text: str) -> list[str]:
    """The text cut at single blanks, which are left out: the tokenizer puts one before each word."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return _SINGLE.split(text)
    return text.split(" ")


class _Pieces:
    """The library's ids of whole texts, from those of their words; words met before are forgotten when they fill ``CACHE`` bytes."""

    def __init__(self, model, pieces: list[str]):
        self.model, self.known, self.bytes = model, {}, 0
        # The library must read a word as it reads it within a text.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and Normaliser.read(model) == Normaliser()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            cut = [stretches(t) for t in texts]
            ids = iter(self.model.encode([s for part in cut for s in part], num_threads=1))
            return [np.array([i for _ in part for i in next(ids)], dtype=np.int32) for part in cut]
        if self.bytes > CACHE:
            self.known, self.bytes = {}, 0
        cut = [words(t) for t in texts]
        new = list({w for part in cut for w in part if w not in self.known})
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self.known[word] = packed = array("i", ids).tobytes()
            self.bytes += 2 * len(word) + len(packed) + 200  # with the objects around them
        return [np.frombuffer(b"".join(map(self.known.__getitem__, part)), np.int32) for part in cut]


@cache
def sides(bytes_model: str, pieces_model: str) -> tuple[Side, Side]:
    """Both vocabularies, once per Python worker. The files must be there wherever the tasks run."""
    import sentencepiece

    machine = merge_automaton.compiled(bytes_model)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    labels = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    return Side(lambda texts: [machine.encode(" " + t, special=False) for t in texts], machine.labels), Side(_Pieces(model, pieces), labels)


@dataclass
class Tokens:
    """The tokens of a portion's documents."""

    ids: pa.Array
    doc: pa.Array
    counts: np.ndarray  # per document

    @staticmethod
    def of(lists: pa.ListArray) -> Tokens:
        return Tokens(pc.list_flatten(lists), pc.list_parent_indices(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

    def ends(self, side: Side) -> pa.Array:
        """Document and end of each token in one number."""
        sizes = pa.array(side.sizes[self.ids.to_numpy()])
        total = pc.cumulative_sum(sizes)
        first = np.cumsum(self.counts) - self.counts
        first = np.where(self.counts > 0, first, 0)
        before = pc.subtract(total.take(pa.array(first)), sizes.take(pa.array(first))) if len(total) else total
        return pc.add(pc.shift_left(self.doc, 32), pc.subtract(total, before.take(self.doc)))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0)]).astype(np.int32)))


def _joined(strings: pa.Array, owner: np.ndarray, owners: int, between) -> pa.Array:
    """One string per owner; ``owner`` of each string rises."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), between)


def alignment(texts: list[str | None], a: Side, b: Side) -> dict[str, pa.Array]:
    """Counts, groups and linked pairs of a portion of documents, each as one value a document."""
    n, width = len(texts), len(b.labels)
    some = [t or "" for t in texts]
    full = [k for k, t in enumerate(some) if t]
    cut_a, cut_b = ([np.empty(0)] * n for _ in range(2))
    for side, cut in ((a, cut_a), (b, cut_b)):
        for k, ids in zip(full, side.encode([some[k] for k in full])):
            cut[k] = ids
    # Only documents that both sides give back are aligned.
    want = pa.array([b" " + t.encode() if t else b"" for t in some], pa.binary())
    for side, cut in ((a, cut_a), (b, cut_b)):
        tokens = _lists(cut)
        given = pc.binary_join(pa.ListArray.from_arrays(tokens.offsets, side.labels.take(tokens.values)), b"")
        for k in np.flatnonzero(~pc.equal(given, want).to_numpy(zero_copy_only=False)):
            cut_a[k] = cut_b[k] = np.empty(0)
    left, right = Tokens.of(_lists(cut_a)), Tokens.of(_lists(cut_b))

    ends = pa.table({"key": left.ends(a), "a": left.ids}).join(pa.table({"key": right.ends(b), "b": right.ids}), "key", join_type="full outer", use_threads=False)
    ends = ends.sort_by("key").combine_chunks()
    doc = pc.shift_right(ends["key"], 32).to_numpy()
    both = pc.and_(ends["a"].is_valid(), ends["b"].is_valid()).to_numpy().astype(np.int64)
    group = np.cumsum(both) - both
    groups = int(both.sum())
    own = {side: ends[side].is_valid().to_numpy() for side in "ab"}
    texts_of = {side: _joined(_one(ends[side].drop_null()).cast(pa.string()), group[own[side]], groups, ",") for side in "ab"}
    spelled = pc.binary_join_element_wise(texts_of["a"], texts_of["b"], "|")

    code = pc.add(pc.multiply(_one(pc.fill_null_backward(ends["a"])), width), _one(pc.fill_null_backward(ends["b"])))
    pairs = pa.table({"doc": pa.array(doc), "code": code}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    pairs = pairs.sort_by([("doc", "ascending"), ("code", "ascending")])
    offsets = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    per_doc = lambda weight: pa.array(np.bincount(doc, weight, n).astype(np.int64))
    return {
        "n_a": pa.array(left.counts.astype(np.int64)),
        "n_b": pa.array(right.counts.astype(np.int64)),
        "n_groups": per_doc(both),
        "n_links": per_doc(None),
        "groups": _joined(spelled, doc[both == 1], n, ";"),
        "codes": pa.ListArray.from_arrays(offsets, _one(pairs["code"]).cast(pa.int32())),
        "times": pa.ListArray.from_arrays(offsets, _one(pairs["count_all"]).cast(pa.int32())),
    }


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_RESULT = [StructField(name, LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")] + [
    StructField("groups", StringType()),
    StructField("codes", ArrayType(IntegerType())),
    StructField("times", ArrayType(IntegerType())),
]


def portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold ``PORTION`` bytes of text at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy().astype(np.int64)
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > PORTION:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def aligned(docs: DataFrame, bytes_model: str = BYTES_MODEL, pieces_model: str = PIECES_MODEL, text: str = "text") -> DataFrame:
    """``docs`` without their texts, with numbers of tokens, groups and links, the groups as ids, and each linked pair
    (``code`` is A's id times B's size plus B's id) with the times it is linked."""
    results = {f.name for f in _RESULT}
    names = [c for c in docs.columns if c != text and c not in results]
    schema = StructType([docs.schema[c] for c in names] + _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(bytes_model, pieces_model)
        for batch in batches:
            for part in portions(batch, text):
                found = alignment(part[text].to_pylist(), a, b)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *found.values()], [*names, *found])

    return docs.select(*[F.col(f"`{c}`") for c in [*names, text]]).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """code and n: in how many rows of ``aligned`` the pair is linked."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("code", use_threads=False).aggregate([("n", "sum")]).select(["code", "n_sum"]).rename_columns(["code", "n"])

        for batch in batches:
            found = pa.table({"code": pc.list_flatten(batch["codes"])}).group_by("code", use_threads=False).aggregate([([], "count_all")])
            held.append(found.select(["code", "count_all"]).rename_columns(["code", "n"]))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    return rows.select("codes").mapInArrow(partial, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, width: int) -> DataFrame:
    """``counts`` with ``best``: no pair of the same A id is held by more documents."""
    a = F.expr(f"code div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # one row per A id, so no more than its vocabulary
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, frequent: int = FREQUENT) -> int:
    """The least number of documents that at most ``frequent`` pairs reach; of some 500 steps, a twelfth part apart."""
    step = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        taken += row["pairs"]
        if taken > frequent:
            break
        least = row["n"]
    return least or 1 << 62


def scored(rows: DataFrame, frequent: int = FREQUENT, width: int | None = None) -> DataFrame:
    """``rows`` of ``aligned``, written down by ``numbered``, with n_best and count_sum.

    n_best counts the links whose pair no other pair of its A id exceeds, count_sum adds up the pairs' counts over all links.
    """
    width = width or len(sides(BYTES_MODEL, PIECES_MODEL)[1].labels)
    counts = landed(ranked(landed(pair_counts(rows), "pair_counts"), width), "ranked_pairs")
    least = threshold(counts, frequent)
    top = counts.filter(F.col("n") >= least).toArrow().combine_chunks().sort_by("code")  # FREQUENT rows at most
    shared = rows.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("code", "n", "best")))
    names = [c for c in rows.columns if c not in ("codes", "times", "n_best", "count_sum")]

    def places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code is among the frequent ones, and whether it is."""
        known = shared.value[0]
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        return at, (known[at] == codes) if len(known) else np.zeros(len(codes), bool)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(x.to_numpy() for x in (pc.list_flatten(batch["codes"]), pc.list_flatten(batch["times"]), pc.list_parent_indices(batch["codes"])))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, doc = flat(batch)
            at, here = places(codes)
            _, n, best = shared.value
            at, times, doc = at[here], times[here].astype(np.int64), doc[here]
            sums = []
            for value in (times * best[at], times * n[at]) if len(at) else (times, times):
                out = np.zeros(batch.num_rows, np.int64)
                np.add.at(out, doc, value)
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *sums], [*names, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, doc = flat(batch)
            rest = ~places(codes)[1]
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(doc[rest])), pa.array(codes[rest]), pa.array(times[rest])], ["row", "code", "times"])

    schema = StructType([rows.schema[c] for c in names] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])
    seldom = rows.select("row", "codes", "times").mapInArrow(rare, "row long, code int, times int")
    seldom = seldom.join(counts.filter(F.col("n") < least), "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    seldom = landed(seldom, "seldom")
    found = rows.mapInArrow(common, schema)
    both = found.join(seldom, found["row"] == seldom["row"], "left")
    more = lambda own, other: (found[own] + F.coalesce(seldom[other], F.lit(0))).alias(own)
    return both.select(*[found[f"`{c}`"] for c in names], more("n_best", "more_best"), more("count_sum", "more_sum"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` written down, each with a number of its own, ``row``."""
    return landed(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
