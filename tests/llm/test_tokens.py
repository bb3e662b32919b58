"""Merge automaton and alignment against the libraries, clustering against a plain loop."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sqlassay.llm import alignment, centroids, merge_automaton, pieces
from sqlassay.llm.registry import QUERIES
from sqlassay.session import landed
from tests.llm.conftest import frame, read

FOLDER = "/root/testdata/sf0.001"
os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [None, "", " ", "  \n\t ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|", "it's we'll I'D", "中文 и 中文", "\U0001F600​ é", "▁ a▁", "x  y   z ", " lead", "\x00\x1c\x85", "�", "a" * 3000, "ab" * 700 + " " * 900, "<0x0A> <s> </s> <unk>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(merge_automaton.MODEL)


# ---- merge automaton


def merged_by_hand(word, merges):
    """The merges one after the other, each from the left."""
    symbols = [bytes([b]) for b in word]
    for u, v in merges:
        k, out = 0, []
        while k < len(symbols):
            if symbols[k : k + 2] == [u, v]:
                out.append(u + v)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(12))
def test_small_automata_take_exactly_what_merging_gives(seed):
    rng = random.Random(seed)
    made, merges = [b"a", b"b", b"c"], []
    while len(merges) < 12:
        pair = (rng.choice(made), rng.choice(made))
        if pair[0] + pair[1] not in made and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            made.append(pair[0] + pair[1])
    of = {label: k for k, label in enumerate(made)}
    machine = merge_automaton.Automaton(dict(enumerate(made)), [(of[u], of[v], of[u + v]) for u, v in merges], {})
    for _ in range(400):
        word = bytes(rng.choice(b"abc" if seed % 2 else b"aab") for _ in range(rng.randint(1, 14)))
        path = merged_by_hand(word, merges)
        assert [made[t] for t in machine.path(word)] == path
        # No other sequence of tokens is a path: join two neighbours or cut one.
        assert all(machine.arc(of[u], of[v]) for u, v in zip(path, path[1:]))
    for u in made:
        for v in made:
            if merged_by_hand(u, merges) == [u] and merged_by_hand(v, merges) == [v]:
                assert machine.arc(of[u], of[v]) == (merged_by_hand(u + v, merges) == [u, v])


def test_vocabularies_without_an_automaton_are_refused():
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aba"}
    with pytest.raises(ValueError):
        merge_automaton.Automaton(labels, [(2, 0, 3), (0, 1, 2)], {})
    with pytest.raises(ValueError):
        merge_automaton.Automaton(labels, [(0, 1, 2), (0, 1, 2)], {})


def test_encoding_equals_the_library(library):
    machine = merge_automaton.compiled(merge_automaton.MODEL)
    rng = random.Random(7)
    bits = ["a", "aa", " ", "  ", "\n", "<|endoftext|>", "<|endo", "'s", "é", "中文", "\U0001F600", "12", "_", "----", "http", "ing", " the", "THE", "\t"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for special in (True, False):
        library.encode_special_tokens = not special
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            ids = machine.encode(text, special).tolist()
            assert ids == want.ids, text
            assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    library.encode_special_tokens = False


def test_long_texts_in_portions_and_forgotten_words(library, prose, monkeypatch):
    monkeypatch.setattr(merge_automaton, "PORTION", 50)
    monkeypatch.setattr(merge_automaton, "CACHE", 4000)
    monkeypatch.setattr(merge_automaton, "ARCS", 20)
    machine = merge_automaton.read(merge_automaton.MODEL)
    text = prose(4000, 3) + " " * 200 + "x" * 5000
    assert machine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert machine.words.bytes <= 4000 and len(machine._arcs) <= 20


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    docs = read(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = QUERIES["op12_merge_automaton"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted((i, *by_library(library, t)) for i, t in docs)


def test_codes_of_awkward_rows(spark, awkward, nothing, library):
    docs = frame(spark, [(i, t, None) for i, t in [*read(awkward), *enumerate(ODD)]]).withColumnRenamed("name", "token_ids").withColumnRenamed("fp", "decoded")
    rows = merge_automaton.decode(merge_automaton.encode(docs))
    assert sorted(rows.columns) == sorted(docs.columns)
    found = [(r["doc_id"], r["token_ids"], r["decoded"], r["kept"]) for r in rows.collect()]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "", "k") for i, t in read(docs)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    packed = [(r["doc_id"], np.frombuffer(r["token_bytes"], "<u4").tolist(), r["decoded"], r["kept"]) for r in merge_automaton.round_trip(docs).collect()]
    assert sorted(packed, key=repr) == sorted(want, key=repr)
    assert merge_automaton.round_trip(nothing).collect() == [] and merge_automaton.encode(nothing).collect() == []
    assert merge_automaton.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).collect()[0]["decoded"] is None


# ---- alignment


@pytest.fixture(scope="module")
def tokenizers():
    exact = Tokenizer.from_file(alignment.BYTES_MODEL)
    exact.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_MODEL)
    letters = merge_automaton.byte_letters()

    def cut(text):
        a = [(i, bytes(letters[c] for c in exact.id_to_token(i))) for i in exact.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
        want = (" " + text).encode()
        return (a, b) if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return cut


def spans(tokens):
    at, out = 0, []
    for i, label in tokens:
        out.append((i, at, at + len(label)))
        at += len(label)
    return out


def aligned_by_hand(texts, cut):
    rows, held = [], Counter()
    for text in texts:
        a, b = map(spans, cut(text or ""))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 400 else _sweep(a, b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)) if len(a) < 400 else "|".join(",".join(map(str, _inside(side, start, end))) for side in (a, b)))
            start = end
        held.update(set(links))
        rows.append((len(a), len(b), groups, links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(n_a, n_b, len(g), len(x), digest(g), sum(held[p] == top[p[0]] for p in x), sum(held[p] for p in x)) for n_a, n_b, g, x in rows]


def _sweep(a, b):
    """Overlapping pairs of two lists of spans that follow each other."""
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return links


def _inside(side, start, end):
    from bisect import bisect_left

    return [i for i, *_ in side[bisect_left(side, start, key=lambda t: t[1]) : bisect_left(side, end, key=lambda t: t[1])]]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment_query_against_brute_force(spark, tokenizers):
    docs = read(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = QUERIES["op13_token_alignment"](spark, FOLDER)
    assert sorted(found.columns) == sorted(["doc_id", *COLUMNS])
    want = aligned_by_hand([t for _, t in docs], tokenizers)
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found.collect()) == sorted((i, *w) for (i, _), w in zip(docs, want))


@pytest.mark.parametrize("frequent", [0, 30, 1 << 20])
def test_frequent_and_rare_pairs_are_counted_alike(spark, awkward, tokenizers, frequent):
    rows = [(k, t) for k, (_, t) in enumerate([*read(awkward), *enumerate(ODD), *enumerate(["the same words"] * 5)])]
    docs = frame(spark, [(i, t, "s") for i, t in rows]).withColumnRenamed("name", "n_a").withColumnRenamed("fp", "groups").withColumnRenamed("bucket", "code")
    aligned = alignment.aligned(docs)
    assert set(docs.columns) - {"text"} <= set(aligned.columns)
    numbered = alignment.numbered(aligned)
    found = {r["doc_id"]: r for r in alignment.scored(numbered, frequent).collect()}
    for (i, t), want in zip(rows, aligned_by_hand([t for _, t in rows], tokenizers)):
        got = found[i]
        assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"]) == want[:4], t
        assert (hashlib.sha256(got["groups"].encode()).hexdigest() if got["groups"] else "") == want[4]
        assert (got["n_best"], got["count_sum"], got["code"]) == (*want[5:], "b")


def test_alignment_of_nothing(spark, nothing):
    assert alignment.scored(alignment.numbered(alignment.aligned(nothing))).collect() == []
    odd = frame(spark, [(1, None, "s"), (2, "▁", "s")])
    assert [(r["n_links"], r["n_best"], r["count_sum"]) for r in alignment.scored(alignment.numbered(alignment.aligned(odd))).collect()] == [(0, 0, 0)] * 2


def test_portions_and_stretches(prose, monkeypatch):
    text = prose(3000, 8) + "   " + prose(40, 9) + "  "
    cut = alignment.stretches(text, 500)
    assert " ".join(cut) == text and len(cut) > 10
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_MODEL)
    assert [i for ids in model.encode(cut) for i in ids] == model.encode(text)
    assert alignment.stretches("x" * 900, 100) == ["x" * 900] and alignment.stretches("a b", 1) == ["a", "b"]
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 700_000, None, "y" * 400_000, "z" * 3_000_000, ""]})
    parts = [p["t"].to_pylist() for p in alignment.portions(batch, "t")]
    assert [t for p in parts for t in p] == batch["t"].to_pylist() and [len(p) for p in parts] == [2, 1, 1, 1]


# ---- clusters


def clustered_by_hand(rows, components, clusters, rounds, seed):
    whole = [(i, v) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    grid = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in whole]
    order = sorted(grid, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [v for _, v in order[:clusters]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((gap(v, c), k) for k, c in enumerate(middles))
    for _ in range(rounds):
        members = {}
        for _, v in grid:
            members.setdefault(nearest(v)[1], []).append(v)
        middles = [[sum(xs) // len(xs) for xs in zip(*members[k])] if k in members else c for k, c in enumerate(middles)]
    found = [(i, *nearest(v)[::-1]) for i, v in grid]
    of = Counter()
    for _, k, d in found:
        of[k] += d
    return [(i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest()) for i, k, d in found]


def vectors(spark):
    rng = random.Random(11)
    rows = [(k, [rng.gauss(k % 3, 0.4) for _ in range(4)]) for k in range(120)] + [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(200, 260)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.5] * 4), (7, [-9.0, -9.0, 0.0, 0.0]), (7, [-9.0, -9.0, 0.0, 0.0]), (None, [0.25] * 4)]
    return rows, spark.createDataFrame([(i, v, 1, 2, "g") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance long, grid string")


@pytest.mark.parametrize("clusters", [1, 5, 8])
def test_clusters_against_a_plain_loop(spark, clusters):
    rows, df = vectors(spark)
    found = centroids.with_totals(*centroids.clusters_of(df.repartition(5), components=4, clusters=clusters, rounds=6)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(clustered_by_hand(rows, 4, clusters, 6, centroids.SEED), key=repr)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows, df = vectors(spark)
    few = df.filter("vec_id in (1, 2, 300, 304)")
    found = centroids.with_totals(*centroids.clusters_of(few, components=4)).collect()
    assert [(r["distance"], r["inertia"]) for r in found] == [(0, 0)] * 2 and {r["cluster"] for r in found} == {0, 1}
    none = centroids.with_totals(*centroids.clusters_of(df.filter("vec_id = 300"), components=4))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_far_components_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    rows, middles, _ = centroids.clusters_of(df, clusters=2, rounds=0)
    assert {r["vec_id"]: max(map(abs, r["grid"])) for r in rows.collect()} == {1: 1 << 27, 2: 1 << 27, 3: 0}
    assert max(r["distance"] for r in rows.collect()) <= 1 << 62


def test_centroids_are_found_by_built_in_functions(spark):
    grids = landed(centroids.on_grid(spark.read.parquet(f"{FOLDER}/embeddings.parquet")), "grids")
    plan = centroids.assigned(grids, centroids.starts(grids))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and "array_min" in plan and "Python" not in plan and "Arrow" not in plan


def test_pieces_of_words_are_those_of_the_text():
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_MODEL)
    rng = random.Random(21)
    parts = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "\r", "é", "中", "\U0001F600", "'s", "12", " ", "　", "ﬁ", "́", "<s>", "<0x41>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a▁ b", "a ▁b", " a b ", "a  b c", " "]
    side = alignment._Pieces(model, [model.id_to_piece(i) for i in range(model.get_piece_size())])
    assert side.by_word and [ids.tolist() for ids in side(texts)] == model.encode(texts)
    asked = []
    side.model = type("Library", (), {"encode": lambda self, lines, **_: asked.extend(lines) or model.encode(lines)})()
    assert [ids.tolist() for ids in side(texts)] == model.encode(texts) and not asked  # every word was met before


def test_pieces_of_words_are_forgotten_when_they_fill_their_room(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 1000)
    side = alignment.sides.__wrapped__(alignment.BYTES_MODEL, alignment.PIECES_MODEL)[1].encode
    for k in range(20):
        assert side([f"word{k} and {k}"])[0].tolist() == side.model.encode(f"word{k} and {k}")
    assert len(side.known) < 12


def test_chunks_are_remembered_over_many_others():
    computed = []
    table = pieces._Recent(lambda key: computed.append(key) or key, pieces._MET)
    for _ in range(2):
        assert all(table[k] == k for k in range(250_000))
    assert len(computed) == 250_000


def test_words_of_many_documents_are_remembered():
    """400,000 words, as 9,000 of the given documents hold, are looked up once each."""
    met = []

    class Machine:
        def path(self, word):
            met.append(word)
            return [1, 2]

    words = merge_automaton._Words(Machine())
    for _ in range(2):
        for k in range(400_000):
            words[str(k)]
    assert len(met) == 400_000
