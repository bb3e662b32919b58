"""SentencePiece encoding and decoding as a weighted transducer.

Three machines are compiled from a model: the normaliser (leading blank, blanks as the piece
alphabet's mark, the model's rules for characters), the pieces (an automaton of their texts) and the
byte fallback (a character without a piece becomes its UTF-8 bytes). Composing them with an input gives a
lattice of pieces over positions; the encoding is its shortest path in the tropical semiring.

* Unigram vocabularies weigh an arc by minus its score.
* Merge vocabularies (BPE) have no additive scores. A sequence of pieces is what the merges
  produce exactly when each two neighbours are, so the weight of an arc depends on the piece
  before it: 0 if the merges leave the two apart and infinity if they would not. One finite path
  is left, and it is the encoding. As this holds for every beginning of an input too, at most
  one state (position, last piece) of a position is at a finite distance, and one distance per
  position is enough for both kinds of weights.

Whether two pieces are left apart is read off the two pieces' own merges: as long as merges come in
order of rank, each facing part lives until its own merge, and two facing parts merge if their common piece
ranks before both. Pieces whose merges do not come in that order are merged anew with their neighbour.

Where no piece reaches across a cut (checked when compiled), inputs are composed in chunks: letters, or other
characters, with the blanks before them. Chunks met lately are looked up. The tables of what was met hold a fixed number of
entries; other memory is bounded by the longest chunk and the ids of the text, and time is linear.

Defined cases: null stays null; an empty text has no pieces; a text of any length is encoded
whole; a literal U+2581 is the blank mark and decodes as a blank; an unpaired surrogate cannot
occur in a Spark string; repeated rows repeat; an empty table gives an empty result; other
columns are passed on, and a column of a result's name is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Where inputs may be cut, the finest first: at blanks and between letters and other characters, or at blanks only.
_LETTER, _OTHER = r"[^\W\d_²³¹]", rf"(?:(?!{MARK})[\W\d_²³¹])"
_CHUNKS = [re.compile(f"{MARK}*(?:{_LETTER}+|{_OTHER}+)|{MARK}+"), re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")]
#: Characters cut at a time, and the length from which a chunk is not remembered.
_TOGETHER, _LONG = 1 << 16, 64
#: Rows whose ids are held at a time.
_ROWS = 256
#: Entries of a table of what was met lately: half of them are the latest ones.
_MET, _PAIRS = 600_000, 600_000
#: Arcs are numbered by the piece's id, those of the byte fallback by the character from here on; START is before the first arc.
_FALLBACK, _BITS = 1 << 20, 22
_START = (1 << _BITS) - 1
_NEVER = float("inf")


class _Recent(dict):
    """A function's values for the arguments met lately, at most ``size`` of them."""

    def __init__(self, compute: Callable, size: int, remembers: Callable = lambda key: True):
        super().__init__()
        self.compute, self.half, self.remembers, self.before = compute, size // 2, remembers, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if self.remembers(key):
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


@dataclass(frozen=True)
class Normaliser:
    """What is done to a text before pieces are sought."""

    leading_blank: bool = True
    one_blank: bool = False  # runs of blanks are one, none at the ends
    rules: dict[int, str] = field(default_factory=dict)

    @staticmethod
    def read(model) -> Normaliser:
        """From how the model itself normalises: every character of the first three planes, blanks, and the beginning."""
        leading = model.normalize("a").startswith(MARK)
        plain = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and c != 0x20]
        bare = lambda text: model.normalize(f"a{text}a")[leading + 1 : -1]
        joined = "a".join(plain)
        rules = {} if bare(joined) == joined else {ord(c): bare(c) for c in plain if bare(c) != c}
        return Normaliser(leading, bare("  ") == bare(" "), rules)

    def __call__(self, text: str) -> str:
        if self.rules:
            text = text.translate(self.rules)
        if self.one_blank:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.leading_blank else "") + text.replace(" ", MARK) if text else ""


@dataclass(frozen=True)
class Vocabulary:
    """What is read from a model: piece texts with scores, ids of the 256 bytes, and whether pieces come from merges."""

    pieces: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    merges: bool
    texts: tuple[bytes, ...]  # of each id, for decoding
    normaliser: Normaliser = Normaliser()

    @staticmethod
    def read(path: str, merges: bool = True) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        of_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        texts = [b"" if special(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode() for i in ids]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not special(i) and not model.is_byte(i)}
        return Vocabulary(pieces, tuple(of_byte[b] for b in range(256)), merges, tuple(texts), Normaliser.read(model))


class Transducer:
    """The compiled machines."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = vocabulary.pieces
        self.text_of_id = {i: text for text, (i, _) in self.pieces.items()}
        if any(score > 0 for _, score in self.pieces.values()) or max(self.text_of_id, default=0) >= _FALLBACK:
            raise ValueError("scores must not be positive, and ids must be below 2^20")
        self.single = {text for text in self.pieces if len(text) == 1}
        # None if some piece reaches across every kind of cut.
        self.cut = next((cut for cut in _CHUNKS if all(cut.fullmatch(text) for text in self.pieces)), None)
        self.automaton = ahocorasick.Automaton()
        for text, (i, _) in self.pieces.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.unknown = 10.0 - min((score for _, score in self.pieces.values()), default=0.0)
        self.faces: dict[int, tuple[list, list, bool] | None] = {}  # an entry per piece at most
        self.weights = _Recent(self.weight, _PAIRS)
        self.ids = _Recent(lambda chunk: self.ids_of(self.shortest_path(chunk)), _MET, lambda chunk: len(chunk) < _LONG)

    def encode(self, text: str) -> np.ndarray:
        normal = self.vocabulary.normaliser(text)
        found = [b"".join(map(self.ids.__getitem__, chunks)) for chunks in self.chunks(normal)]
        return np.frombuffer(b"".join(found), np.int32)

    def chunks(self, normal: str) -> Iterator[list[str]]:
        """A normal text cut into chunks, some at a time."""
        if self.cut is None:
            yield [normal]
            return
        at = 0
        while at < len(normal):
            found = self.cut.findall(normal, at, at + _TOGETHER)
            at += _TOGETHER
            if at < len(normal):
                at -= len(found.pop())  # it may go on
                if not found:
                    found = [self.cut.match(normal, at)[0]]
                    at += len(found[0])
            yield found

    def ids_of(self, arcs: list[int]) -> bytes:
        """The ids of a path's arcs as 32-bit integers."""
        if max(arcs, default=0) >= _FALLBACK:
            arcs = [i for arc in arcs for i in ([arc] if arc < _FALLBACK else [self.vocabulary.bytes_[b] for b in self.text_of(arc).encode("utf-8", "surrogatepass")])]
        return array("i", arcs).tobytes()

    def text_of(self, arc: int) -> str:
        return self.text_of_id[arc] if arc < _FALLBACK else chr(arc - _FALLBACK)

    def arcs(self, chunk: str) -> Iterable[tuple[int, tuple[int, int]]]:
        """The composition's arcs by their last position: pieces, and the fallback where no piece is one character."""
        found = self.automaton.iter(chunk) if self.pieces else iter(())
        if self.single.issuperset(chunk):
            return found
        fallback = [(k, (_FALLBACK + ord(c), 1)) for k, c in enumerate(chunk) if c not in self.single]
        return sorted([*found, *fallback], key=itemgetter(0))

    def shortest_path(self, chunk: str) -> list[int]:
        """The arcs of the path of least weight; no weight is negative, so only a shorter distance is worth an arc."""
        distance = [0.0] + [_NEVER] * len(chunk)
        last, sizes = [_START << _BITS] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        weights = self.weights
        for end, (arc, size) in self.arcs(chunk):
            start = end + 1 - size
            best = distance[end + 1]
            if distance[start] < best and (reached := distance[start] + weights[last[start] | arc]) < best:
                end += 1
                distance[end], last[end], sizes[end] = reached, arc << _BITS, size
        if distance[-1] == _NEVER:
            raise ValueError(f"no path through {chunk[:40]!r}")
        path, at = [], len(chunk)
        while at:
            path.append(last[at] >> _BITS)
            at -= sizes[at]
        return path[::-1]

    def weight(self, pair: int) -> float:
        """The weight of an arc after another one."""
        left, arc = pair >> _BITS, pair & _START
        if self.vocabulary.merges:
            return 0.0 if self.apart(left, arc) else _NEVER
        return -self.pieces[self.text_of_id[arc]][1] if arc < _FALLBACK else self.unknown

    def _faces(self, arc: int) -> tuple[list, list, bool] | None:
        """What stands at a piece's two ends while it is merged, with the rank of the merge that ends it.

        And whether its merges come in order of rank. None if the merges of its text do not end in the piece.
        """
        if arc not in self.faces:
            text = self.text_of(arc)
            parts = [(symbol, [], []) for symbol in text]
            ranks = []
            while found := self._next_merge([part[0] for part in parts]):
                rank, k = found
                (a, lefts, _), (b, _, rights) = parts[k], parts[k + 1]
                parts[k : k + 2] = [(a + b, [*lefts, (a, rank)], [*rights, (b, rank)])]
                ranks.append(rank)
            only = parts[0] if len(parts) == 1 else None
            self.faces[arc] = only and ([*only[1], (text, _NEVER)], [*only[2], (text, _NEVER)], ranks == sorted(ranks))
        return self.faces[arc]

    def apart(self, left: int, right: int) -> bool:
        """Do the merges leave these two arcs as neighbours?"""
        after = self._faces(right)
        if left == _START or after is None:
            return after is not None
        before = self._faces(left)
        if before is None:
            return False
        if not (before[2] and after[2]):
            texts = [self.text_of(left), self.text_of(right)]
            return self.merge("".join(texts)) == texts
        rights, lefts, i, j = before[1], after[0], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = rights[i], lefts[j]
            joined = self.pieces.get(a + b)
            # Of merges of equal rank the leftmost comes first.
            if joined and -joined[1] < a_ends and -joined[1] <= b_ends:
                return False
            if a_ends == b_ends == _NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _next_merge(self, symbols: list[str]) -> tuple[float, int] | None:
        """Rank and place of the next merge: the best pair, of equal ones the leftmost."""
        return min(((-self.pieces[a + b][1], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.pieces), default=None)

    def merge(self, text: str) -> list[str]:
        """The merges on a text of two pieces at most, until no pair is a piece."""
        symbols = list(text)
        while found := self._next_merge(symbols):
            k = found[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def decode(self, ids) -> str:
        texts = self.vocabulary.texts
        text = b"".join([texts[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.vocabulary.normaliser.leading_blank and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer per Python worker and model file."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(Vocabulary.read(path))
    return _COMPILED[path]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each text. The model file must be at that path on every executor."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(model)
        for texts in (batch[k : k + _ROWS] for batch in batches for k in range(0, max(len(batch), 1), _ROWS)):
            yield pd.Series([None if t is None else machine.encode(t) for t in texts], dtype=object)

    return docs.withColumn(ids, encoded(F.col(text)))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids."""

    @F.pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(model)
        for each in batches:
            yield pd.Series([None if i is None else machine.decode(i.tolist()) for i in each], dtype=object)

    return rows.withColumn(text, decoded(F.col(ids)))


def both_ways(text: Column, model: str = MODEL) -> Column:
    """A struct of a text's piece ids and of the text they decode to, in one pass and by one transducer a worker."""

    @F.pandas_udf(StructType([StructField("piece_ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = compiled(model)
        for texts in (batch[k : k + _ROWS] for batch in batches for k in range(0, max(len(batch), 1), _ROWS)):
            ids = [None if t is None else machine.encode(t) for t in texts]
            yield pd.DataFrame({"piece_ids": pd.Series(ids, dtype=object), "decoded": pd.Series([None if i is None else machine.decode(i.tolist()) for i in ids], dtype=object)})

    return coded(text)
