"""Scores, rules, codes, licenses, packing, resampling and quotes on small fixtures."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlassay.llm import licenses, packing, pieces, quotes, resampling, rules, toxicity
from tests.llm.conftest import frame, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity


def toxic_corpus(spark, prose):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        words = prose(80, 5000 + k).split()
        toxic = k % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Grobnikar", "vlast!", "vlastun", "gr0bnik", "VLАST"]))  # the last has a Cyrillic letter
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_stems_and_holds_on_the_rest(spark, prose):
    docs, labels = toxic_corpus(spark, prose)
    lexicon = toxicity.learn(docs, labels)
    assert {"grobnik", "viast"} <= set(lexicon.entries)
    found = toxicity.scores(docs, lexicon).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    rest = [r for r in found if r["held_out"]]
    assert len(rest) > 100 and sum(r["predicted"] != r["toxic"] for r in rest) == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_held_out_labels_teach_nothing(spark, prose):
    docs, labels = toxic_corpus(spark, prose)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, turned) == toxicity.learn(docs, labels)


def test_toxicity_keeps_what_it_learns_from_on_disk(spark, prose, monkeypatch):
    docs = frame(spark, [(i, prose(20, i) + (" grotwark" if i % 2 else ""), "a") for i in range(240)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept, stems = [], toxicity._stems
    monkeypatch.setattr(toxicity, "_stems", lambda found: kept.extend((i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()) or stems(found))
    spark.catalog.clearCache()
    assert toxicity.learn(docs, labels).entries
    # The sample and its pairs, both formed once.
    assert len(kept) == 2 and all(memory == 0 and disk > 0 for memory, disk in kept)


def test_toxicity_folds_and_excuses():
    lexicon = toxicity.Lexicon({toxicity.folded("idiot"): 4.0, toxicity.folded("scum"): 4.0}, {toxicity.folded("pond scum")})
    built = lexicon.automaton()
    score = lambda text: toxicity.evidence(text, built)
    for text in ("idiot", "an 1d10t here", "IDIOT###", "ｉｄｉｏｔ", "іdіоt", "id​iot", "scum of the earth", "pond scum and scum", "(idiot)"):
        assert score(text) > 0, text
    for text in ("", None, "the antiidiot", "pond scum", "clean words only", "sc um"):
        assert score(text) == 0, text
    assert score("idiot " + "word " * 1000) < score("idiot word")


def test_toxicity_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(awkward, labels)
    assert lexicon.entries and toxicity.scores(awkward, lexicon).count() == awkward.count()
    assert toxicity.scores(nothing, lexicon).collect() == [] and toxicity.clean_documents(nothing, lexicon).columns == nothing.columns
    assert sorted(map(repr, read(toxicity.clean_documents(awkward, lexicon)))) == sorted(map(repr, read(awkward)))
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(awkward, odd).count() == 0


# ---- quality rules


def measures_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rules_measure_whole_texts(spark, awkward, prose):
    texts = [t for _, t in read(awkward)] + ["a b c d e " * 9, "x " * 40, "one\ntwo\none\n \n \none", "# * $ % & | < >", " a\x1cb\x85c d", "p q r s t u p q r s t v", "ÄÖ " * 6]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in rules.verdicts(rules.ledger(docs)).collect()}
    for k, text in enumerate(texts):
        got = tuple(found[k][name] for name in rules.MEASURES[:5])
        assert got == measures_by_hand(text), (k, text[:50] if text else text)
        n, repeat = got[0], got[4]
        assert found[k]["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert found[k]["kept"] == (found[k]["failed"] == 0)


def test_policies_and_ablations_need_the_ledger_only(spark, prose):
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(["too short", prose(50, 1), "SHOUT " + prose(50, 2).upper(), "*** " * 12 + prose(20, 3), "a b c d e " * 9])])
    rows = rules.ledger(docs).drop(*rules.MEASURES)
    kept = {policy: {r["doc_id"] for r in rules.verdicts(rows, policy).filter("kept").collect()} for policy in rules.POLICIES}
    assert kept["prose-2"] <= kept["prose-1"] <= kept["base-1"] and 1 in kept["prose-2"] and 2 not in kept["prose-2"] and 2 in kept["base-1"]
    bits = {r["doc_id"]: r["failed"] for r in rows.collect()}
    for r in rules.ablations(rows).collect():
        mask, bit = rules.mask_of(r["policy"]), rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(1 for b in bits.values() if b & bit)
        assert r["n_only"] == sum(1 for b in bits.values() if b & mask == bit)
        assert r["n_kept"] == sum(1 for b in bits.values() if b & mask == 0)


def test_kept_documents_keep_their_columns(awkward, nothing):
    kept = rules.kept_documents(awkward)
    assert kept.columns == awkward.columns and {i for i, _ in read(kept)} <= {1, 2, 7, 9, None}
    assert rules.kept_documents(nothing).collect() == [] and rules.ledger(nothing).collect() == []


# ---- pieces


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["", " ", "  a   b ", " " * 41, "tab\tnew\nline", "".join(map(chr, range(1, 1500))), "\U0001F600 한국어 العربية", "for(i=0;i<n;i++){\n        x += 1;\n}", None]
    docs = docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    model = library()
    for r in pieces.decode(pieces.encode(docs)).collect():
        if r["text"] is None:
            assert r["piece_ids"] is None and r["decoded"] is None
        else:
            assert r["piece_ids"] == model.encode(r["text"]), r["text"][:60]
            assert r["decoded"] == r["text"]


def test_scores_take_the_cheapest_path():
    texts = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "ba": -3.1, "aba": -6.0, "▁a": -2.2}
    vocabulary = pieces.Vocabulary({t: (k + 256, s) for k, (t, s) in enumerate(texts.items())}, tuple(range(256)), False, ())
    machine = pieces.Transducer(vocabulary)
    cost = lambda path: sum(-texts.get(p, -machine.unknown) for p in path)
    for size in range(1, 7):
        for letters in product("▁abc", repeat=size):
            word = "".join(letters)
            cuts = ([word[a:b] for a, b in zip((0, *at), (*at, size))] for at in (tuple(k for k in range(1, size) if mask >> k & 1) for mask in range(0, 1 << size, 2)))
            best = min(cost(cut) for cut in cuts if all(p in texts or p == "c" for p in cut))
            assert cost([machine.text_of(arc) for arc in machine.shortest_path(word)]) == pytest.approx(best)


def test_pieces_left_apart_as_the_merges_say():
    """Facing parts tell the same as merging two pieces anew, also where merges come out of order of rank."""
    rng = random.Random(4)
    for _ in range(30):
        texts = {"a", "b", "c"}
        while len(texts) < 20:
            texts.add(rng.choice(sorted(texts)) + rng.choice(sorted(texts)))
        order = rng.sample(sorted(texts), len(texts))
        vocabulary = pieces.Vocabulary({t: (k, -float(k)) for k, t in enumerate(order)}, tuple(range(256)), True, ())
        machine = pieces.Transducer(vocabulary)
        for left, right in product(range(len(order)), repeat=2):
            pair = [order[left], order[right]]
            assert machine.apart(left, right) == (machine.merge("".join(pair)) == pair), (order, pair)


def test_pieces_of_long_texts_and_rules(monkeypatch, spark, nothing):
    model, machine = library(), pieces.compiled(pieces.MODEL)
    rng = random.Random(5)
    long = "".join(rng.choice(["the ", "  ", "\n", "aé", "12", "m² ", "한", ", "]) for _ in range(3000)) + "x" * 500
    for window in (1, 7, 64, 1 << 16):
        monkeypatch.setattr(pieces, "_TOGETHER", window)
        assert machine.encode(long).tolist() == model.encode(long)
    monkeypatch.setattr(machine, "cut", None)
    machine.ids.clear()
    assert machine.encode(long).tolist() == model.encode(long)
    assert pieces.Normaliser.read(model) == pieces.Normaliser(True, False, {})
    assert pieces.Normaliser(True, True, {ord("ﬁ"): "fi"})("  a  ﬁn ") == "▁a▁fin"


def test_pieces_of_awkward_tables(spark, nothing):
    empty = nothing.select("doc_id", "text", pieces.both_ways(F.col("text")).alias("coded")).select("doc_id", "coded.*")
    assert empty.collect() == [] and pieces.decode(pieces.encode(nothing)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, piece_ids int")
    rows = pieces.decode(pieces.encode(docs)).select("doc_id", "piece_ids", "decoded").collect()
    ids = library().encode("a b")
    assert sorted(map(str, rows)) == sorted(map(str, [*rows[:0], *[type(rows[0])(doc_id=d, piece_ids=i, decoded=t) for d, i, t in [(1, ids, "a b"), (1, ids, "a b"), (None, None, None), (2, [], "")]]]))
    coded = docs.select("doc_id", pieces.both_ways(F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    assert sorted(map(str, coded)) == sorted(map(str, rows))


# ---- licenses


def test_license_spans(spark, awkward, nothing, prose):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    edited = mit.replace("publish, distribute, sublicense,", "publish or").replace("persons", "people")
    cases = {
        0: (prose(30, 1) + "\n" + mit + "\n" + prose(30, 2), ["MIT"]),
        1: (edited, ["MIT"]),
        2: (prose(5000, 3) + " Licensed under CC BY-NC 4.0. " + prose(50, 4) + "\nReleased under the MIT License.", ["CC-BY-NC-4.0 (line)", "MIT (line)"]),
        3: ("Released under the MIT License. " * 3, ["MIT (line)"] * 3),
        4: (apache.upper().replace(" ", "\n"), ["Apache-2.0"]),
        5: (" ".join(reversed(mit.split())), []),
        6: ("the license of the software is free", []),
    }
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, [(k, t, "s") for k, (t, _) in cases.items()])).collect()}
    for k, (text, names) in cases.items():
        assert [span["license"] for span in found[k]] == names, k
        assert all(0.8 <= span["coverage"] <= 1 and 0 <= span["first"] < span["end"] <= len(text) for span in found[k])
    assert cases[2][0][found[2][0]["first"] : found[2][0]["end"]] == "Licensed under CC BY-NC 4.0"
    assert all(r["licenses"] == [] for r in licenses.scan(awkward).collect()) and licenses.scan(nothing).collect() == []


def test_licenses_are_told_from_their_neighbours():
    gpl = licenses.TEMPLATES["GPL-3.0"]
    cases = {
        "Released under the BSD License.": ["BSD (line)"],
        "released under the same license": [],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0 (line)"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0 (line)"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0 (line)"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0 (line)"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0 (line)"],
        "Licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0 (line)"],
        "Licensed under the Apache License, Version 1.1": [],
        "Released under the terms of the MIT License.": ["MIT (line)"],
        "Released under the BSD License. The MIT License is another.": ["BSD (line)"],
        gpl: ["GPL-3.0"], gpl.replace("version 3", "version 2"): ["GPL-2.0"], gpl.replace("version 3", "version 4"): [],
        gpl.replace("GNU", "GNU Lesser"): ["LGPL-3.0"], gpl.replace("GNU", "GNU Affero"): ["AGPL-3.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    }
    scanner = licenses.Scanner()
    assert {text: [span[0] for span in scanner.scan(text)] for text in cases} == cases
    for name, texts in licenses.TEMPLATES.items():
        for text in [texts] if isinstance(texts, str) else texts:
            assert [span[:2] for span in scanner.scan(text)] == [(name, 1.0)], name


def test_patience_matches_rise_and_cover():
    rng = random.Random(6)
    for _ in range(300):
        left = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        right = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        pairs = licenses.patience(left, right)
        assert all(left[a] == right[b] for a, b in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert licenses.patience(list("abcdef"), list("abcdef")) == [(k, k) for k in range(6)]
    assert len(licenses.patience(list("abXcde"), list("abcYde"))) == 5
    for _ in range(200):
        pairs = sorted(enumerate(rng.sample(range(12), 8)))
        best = max(len(s) for s in ([p for k, p in enumerate(pairs) if mask >> k & 1] for mask in range(256)) if all(x[1] < y[1] for x, y in zip(s, s[1:])))
        assert len(licenses.rising(pairs)) == best


# ---- packing


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(7)
    for _ in range(60):
        items = [(rng.randint(0, 20), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, 5, None])) for _ in range(40)]
        placed = packing.best_fit(*zip(*items), 20)
        left, held = {}, {}
        for (length, source, cluster), (number, offset) in zip(items, placed):
            fits = [b for b in left if left[b] >= length and (source is None or ("s", source) not in held[b]) and (cluster is None or ("c", cluster) not in held[b])]
            if fits:
                assert number in fits and left[number] == min(left[b] for b in fits)
            else:
                assert number not in left
                left[number], held[number] = 20, set()
            assert offset == 20 - left[number]
            left[number] -= length
            held[number] |= {("s", source), ("c", cluster)}


def test_pack_places_every_piece_once(awkward, nothing):
    packed = [r.asDict() for r in packing.pack(awkward, capacity=512, shard=4).collect()]
    sizes = Counter()
    for r in packed:
        sizes[r["bin_id"]] += r["length"]
        assert 0 <= r["bin_offset"] <= 512 - r["length"] and r["start"] == 512 * r["piece"]
    assert max(sizes.values()) <= 512
    want = Counter()
    for i, t in read(awkward):
        want[i] += len(WORD.findall(t or ""))
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert len([r for r in packed if r["doc_id"] in (1, 2)]) == len({r["bin_id"] for r in packed if r["doc_id"] in (1, 2)})  # copies apart
    assert packing.pack(nothing).collect() == []


# ---- resampling


def test_resampling_tells_target_from_raw(spark, prose):
    rows = [(k, prose(60, k) if k % 3 else " ".join(w + rng for w, rng in zip(prose(60, k).split(), ["***", "###"] * 30)), "s") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    found = resampling.resample(docs, resampling.fit(docs, labels)).collect()
    rest = [r for r in found if r["held_out"]]
    assert len(rest) > 50 and all(r["kept"] == (r["doc_id"] % 3 != 0) for r in rest)
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    assert {r["doc_id"] for r in found if r["sampled"]} == {r["doc_id"] for r in found if r["gumbel_key"] >= keys[149]}


def test_buckets_do_not_depend_on_pieces(monkeypatch, prose):
    whole = np.sort(np.concatenate(list(resampling.buckets_of(prose(500, 1), resampling._Hashes()))))
    monkeypatch.setattr(resampling, "PIECE", 7)
    assert (np.sort(np.concatenate(list(resampling.buckets_of(prose(500, 1), resampling._Hashes())))) == whole).all()


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([-(10**18), -5, 0, 7, 10**12, rng.randint(-(2**63), 2**63 - 1)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 200, 400):
        assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "v", 401) is None


def test_resampling_on_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = resampling.resample(awkward, resampling.fit(awkward, none)).collect()
    assert len(found) == awkward.count() and all(r["kept"] for r in found) and sum(r["sampled"] for r in found) >= math.ceil(len(found) / 2)
    assert resampling.resample(nothing, resampling.fit(nothing, none)).collect() == []


# ---- quotes

MESSAGES = "conv_id long, turn long, role string, text string, depth string, message string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGES)


def test_announcing_lines_of_any_length_are_taken_out(spark):
    long = "On Monday " + "the one and only " * 40 + "Bob wrote:"
    rows = [(1, 0, "user", "How is the new plan going?"), (1, 1, "user", f"{long}\n> How is the new plan going?\nWell."), (1, 2, "user", f"{long}\nno quote follows")]
    own = {r["turn"]: (r["own_text"], r["parent_turn"]) for r in quotes.conversations(talk(spark, rows)).collect()}
    assert own[1] == ("Well.", 0) and own[2] == (f"{long}\nno quote follows", None)


def test_quotes_are_linked_and_taken_out(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\nSecond line here."),
        (1, 1, "assistant", "> Hello there,  HOW are you?\n> Second line here.\n\nI am fine."),
        (1, 2, "user", "On Monday Bob wrote:\n>> Hello there, how are you?\n>> Second line here.\n>\n> I am fine.\nGood to hear."),
        (1, 3, "user", "> Second line here.\nWhich one?"),
        (1, 4, "user", "> never said\nok"),
        (1, 5, "user", "> Which one?\n\n> Good to hear.\nboth"),
        (2, 0, "user", "> I am fine.\nanother conversation"),
        (2, 1, "user", "a > b is no quote"), (2, 1, "user", "again"), (None, 1, "user", "> x"), (3, None, None, None), (4, 0, "user", ""),
    ]
    found = {(r["conv_id"], r["turn"], r["own_text"]): r for r in quotes.conversations(talk(spark, rows)).collect()}
    assert len(found) == len(rows)
    place = lambda c, t: next((r["root_turn"], r["depth"], r["parent_turn"], r["own_text"]) for r in found.values() if (r["conv_id"], r["turn"]) == (c, t))
    assert place(1, 1) == (0, 1, 0, "I am fine.")
    assert place(1, 2) == (0, 2, 1, "Good to hear.")
    assert place(1, 3) == (0, 1, 0, "Which one?")
    assert place(1, 4) == (4, 0, None, "ok")
    assert place(1, 5) == (0, 2, 3, "both")
    assert place(2, 0) == (0, 0, None, "another conversation") and place(4, 0) == (0, 0, None, "")
    order = [(r["conv_id"], r["turn"]) for r in quotes.formatted(talk(spark, rows)).collect() if r["conv_id"] == 1]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 2), (1, 5), (1, 4)]


def test_nested_and_trimmed_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "First line of the plan.\nSecond line of the plan.\nThird line of the plan."),
        (1, 1, "user", "We meet at noon. Bring the blue folder! The room behind the large hall on the second floor is ours until four"),
        (1, 2, "user", "> On Monday Ann wrote:\n>> First line of the plan.\n>> Second line of the plan.\n>> Third line of the plan.\nOnly a nested quote."),
        (1, 3, "user", "> Second line of the plan.\n> Third line of the plan.\nTwo of three lines."),
        (1, 4, "user", "> Bring the blue folder!\nOne sentence."),
        (1, 5, "user", "> [...] behind the large hall on\n> the second floor [...]\nA part, wrapped anew."),
        (1, 6, "user", "> Only a nested quote.\n>> We meet at noon.\nThe outermost level counts."),
        (1, 7, "user", "> never said by anyone here before\n>>> We meet at noon.\nThe next level that links."),
        (1, 8, "user", "> First line of the plan.\n> never said\n> Third line of the plan.\nSome lines."),
        (1, 9, "user", "> some lines that nobody wrote\nNothing."),
        (2, 0, "user", "> Bring the blue folder!\nAnother conversation."),
    ]
    found = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_quotes"], r["n_linked"]) for r in quotes.conversations(talk(spark, rows)).collect()}
    assert found == {
        (1, 0): (None, 0, 0), (1, 1): (None, 0, 0), (1, 2): (0, 1, 1), (1, 3): (0, 1, 1), (1, 4): (1, 1, 1), (1, 5): (1, 1, 1),
        (1, 6): (2, 2, 2), (1, 7): (1, 2, 1), (1, 8): (0, 1, 1), (1, 9): (None, 1, 0), (2, 0): (None, 1, 0),
    }


def test_long_chains_of_replies(spark):
    rows = [(1, k, "user", (f"> message number {k - 1}\n" if k else "") + f"message number {k}") for k in range(70)]
    found = {r["turn"]: (r["root_turn"], r["depth"]) for r in quotes.conversations(talk(spark, rows)).collect()}
    assert found == {k: (0, k) for k in range(70)}
    assert quotes.formatted(talk(spark, [])).collect() == []
