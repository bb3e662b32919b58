"""Byte-level BPE as a deterministic automaton over tokens.

The automaton reads tokens; its paths from the start spell exactly the token sequences that merging
gives. It is built from the machine that allows every sequence of bytes, one gadget a
merge, in their order: for (u, v) -> w,

* the state after u is copied without its arc v (``cut``), and every arc u leads to the copy;
* every state that still has an arc u gets an arc w, which leads where v led.

All arcs of one label lead to one state, so a state is named by the token before it. Its arcs are kept as
differences: a copy has the arcs of the state it was copied from but the one cut,
and an arc w is where the arc u was when w came. ``arc`` looks an arc up along the two parts' spines, at most as
many steps as the two tokens have merges, and remembers it.

As every text has one path only, every prefix of a word is reached in one state: encoding
walks the word's tokens from the left, longest first, and enters no position twice. Decoding joins the labels of the arcs.

Memory: tables of the vocabulary, and the encodings of words met before, up to ``CACHE`` bytes. A long text is
split in portions, a word of any length takes time linear in it.

Defined cases: a null text counts as empty, which has no tokens; a text of any length is encoded whole; the contents of
special tokens are those tokens unless ``special`` is false; repeated rows repeat; an empty table gives an empty result;
other columns are passed on, and a column with the name of a result is replaced. A vocabulary whose merges use a part before it is
made, or make one token twice, has no such automaton and is refused.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructType

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: How the vocabulary's pre-tokenizer splits a text into words. Letters come first here: no other way begins with one.
PATTERN = regex.compile(r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
#: Bytes of remembered words, arcs remembered, words split at a time.
CACHE, ARCS, PORTION = 128 << 20, 300_000, 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it shows, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """The machine of one vocabulary."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """``labels`` are the bytes of each token; ``merges`` are (left, right, token) in their order."""
        self.size = max([*labels, *special.values()]) + 1
        self.labels = [b""] * self.size
        for token, label in labels.items():
            self.labels[token] = label
        for text, token in special.items():
            self.labels[token] = text.encode()
        self.special = special
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.made = [-1] * self.size
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.cut: dict[int, int] = {}
        self.ids = {label: token for token, label in labels.items() if len(label) == 1}
        self._arcs: dict[int, bool] = {}
        known = set(self.ids.values())
        for rank, (u, v, w) in enumerate(merges):
            if u not in known or v not in known or w in known:
                raise ValueError(f"merge {rank} has no gadget: a part is not made yet, or the token is made twice")
            known.add(w)
            if self.labels[u] in self.ids and self.labels[v] in self.ids and self._has(u, rank - 1, v):  # else it never takes place
                self.cut[u * self.size + v] = rank
                self.ids[self.labels[w]] = w
            self.made[w], self.left[w], self.right[w] = rank, u, v
        #: Each beginning of a label, with the token it is itself, if any.
        self.beginnings: dict[bytes, int] = {}
        for label in self.ids:
            for n in range(1, len(label)):
                self.beginnings.setdefault(label[:n], -1)
        self.beginnings.update(self.ids)
        self.words = _Words(self)

    def _has(self, state: int, upto: int, token: int) -> bool:
        """Has the state after ``state``, as gadget ``upto`` left it, an arc ``token``?"""
        made, left, right, cut, size = self.made, self.left, self.right, self.cut, self.size
        while True:
            rank = cut.get(state * size + token)
            if rank is not None and rank <= upto:
                return False
            if made[token] > made[state]:  # it came to a state that was there: where its left part has an arc
                upto = min(upto, made[token])
                token = left[token]
            elif made[state] >= 0:  # the state was that of the right part when the merge came
                upto = made[state] - 1
                state = right[state]
            else:
                return True

    def arc(self, state: int, token: int) -> bool:
        key = state * self.size + token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._has(state, self.size, token)
        return known

    def path(self, word: bytes) -> list[int]:
        """The tokens of one word."""
        if word in self.ids:  # the start has an arc for every token
            return [self.ids[word]]
        end, beginnings, labels, size = len(word), self.beginnings.get, self.labels, self.size
        known, arc = self._arcs.get, self.arc
        entered = bytearray(end + 1)
        path: list[int] = []
        waiting: list[tuple[int, list[int]]] = []  # position, tokens still to try there
        at, fresh = 0, True
        while at < end:
            if fresh:
                open_tokens, to = [], at + 1
                while to <= end and (token := beginnings(word[at:to])) is not None:
                    if token >= 0:
                        open_tokens.append(token)
                    to += 1
                state = path[-1] * size if path else -1
            fresh = False
            while open_tokens:
                token = open_tokens.pop()
                to = at + len(labels[token])
                if entered[to]:
                    continue
                if state < 0 or ((goes := known(state + token)) is None and arc(path[-1], token)) or goes:
                    entered[to] = 1
                    waiting.append((at, open_tokens))
                    path.append(token)
                    at, fresh = to, True
                    break
            if not fresh:
                if not waiting:
                    raise ValueError(f"no path through {word[:40]!r}")
                at, open_tokens = waiting.pop()
                path.pop()
                state = path[-1] * size if path else -1
        return path

    def encode(self, text: str | None, special: bool = True) -> np.ndarray:
        """The token ids of a text, as unsigned 32-bit integers."""
        found: list[bytes] = []
        at = 0
        if special and self._special and text:
            for match in self._special.finditer(text):
                found += self._words_of(text[at : match.start()])
                found.append(_packed([self.special[match.group()]]))
                at = match.end()
        found += self._words_of(text[at:] if at else text or "")
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _words_of(self, text: str) -> list[bytes]:
        get = self.words.__getitem__
        if len(text) < PORTION:
            return list(map(get, PATTERN.findall(text)))
        matches, parts = PATTERN.finditer(text), []
        while portion := [m.group() for m in islice(matches, PORTION)]:
            parts.append(b"".join(map(get, portion)))
        return parts

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    """Little-endian, 32 bits each."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Words met before, with their ids packed; forgotten all at once when they fill ``CACHE`` bytes."""

    def __init__(self, machine: Automaton):
        self.machine, self.bytes = machine, 0

    def __missing__(self, word: str) -> bytes:
        packed = _packed(self.machine.path(word.encode("utf-8", "surrogatepass")))
        if len(word) < 128:
            self.bytes += 2 * len(word) + len(packed) + 200  # with the objects around them
            if self.bytes > CACHE:
                self.clear()
                self.bytes = 0
            self[word] = packed
        return packed


def read(path: str) -> Automaton:
    """The automaton of a vocabulary file. It must be at that path wherever the tasks run."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t[flag] for t in model.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special tokens that take their surroundings with them are not supported")
    letters, vocabulary = byte_letters(), model["model"]["vocab"]
    labels = {token: bytes(letters[c] for c in text) for text, token in vocabulary.items() if text not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
    return Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], special)


_COMPILED: dict[str, Automaton] = {}


def compiled(path: str) -> Automaton:
    """One automaton per Python worker and vocabulary file."""
    if path not in _COMPILED:
        _COMPILED[path] = read(path)
    return _COMPILED[path]


def _per_row(kind: DataType, of_row):
    @F.pandas_udf(kind)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([of_row(row) for row in rows], dtype=object)

    return each


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "token_ids", special: bool = True) -> DataFrame:
    """``docs`` with the token ids of each text."""
    return docs.withColumn(ids, _per_row(ArrayType(IntegerType()), lambda t: compiled(model).encode(t, special))(F.col(text)))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of the token ids; no ids, no text."""
    return rows.withColumn(text, _per_row(StringType(), lambda i: None if i is None else compiled(model).decode(i))(F.col(ids)))


def round_trip(docs: DataFrame, model: str = MODEL, text: str = "text", packed: str = "token_bytes", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids as a token file holds them (little-endian, 32 bits each) and their text, in one pass."""

    @F.pandas_udf(StructType().add("packed", BinaryType()).add("decoded", StringType()))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = compiled(model)
        for texts in batches:
            ids = [machine.encode(t) for t in texts]
            yield pd.DataFrame({"packed": [i.tobytes() for i in ids], "decoded": [machine.decode(i.tolist()) for i in ids]}, dtype=object)

    names = [c for c in docs.columns if c not in (packed, decoded)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], both(F.col(text)).alias("_both"))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.col("_both.packed").alias(packed), F.col("_both.decoded").alias(decoded))


