"""Exact dedup, fuzzy lines, near-dedup and components against brute force."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sqlassay.llm import block_names, components, covering, fuzzy_lines
from tests.llm.conftest import frame, read


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block,digest", [(4096, F.xxhash64), (7, F.xxhash64), (64, lambda c: F.xxhash64(c) % 3)])
def test_exact_dedup(awkward, block, digest):
    docs = awkward if block > 7 else awkward.filter("doc_id IS NULL OR doc_id != 7")
    found = block_names.exact_dedup(docs, block, digest).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, exact_by_hand(read(docs))))


def test_rows_that_repeat_are_given_back(spark, monkeypatch):
    monkeypatch.setattr(block_names, "_PORTION", 3)
    rows = [(1, "one text")] * 8 + [(2, "one text")] * 3 + [(3, "other")] * 2 + [(4, "alone"), (None, "alone"), (None, "alone"), (5, None), (5, "")]
    found = block_names.exact_dedup(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, exact_by_hand(rows)))


def test_exact_dedup_of_nothing(nothing):
    assert block_names.exact_dedup(nothing).collect() == []


def test_names_are_equal_only_for_equal_contents(spark):
    rows = spark.createDataFrame([(k, "abcd"[k % 4] * (k % 3 + 1)) for k in range(60)], "k int, content string")
    named = block_names.named(rows.withColumn("text", F.col("content")), "content", lambda c: F.length(c)).collect()
    assert len({(r["text"], r["name"]) for r in named}) == len({r["text"] for r in named}) == len({r["name"] for r in named})


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(400)] + [(0, k) for k in range(1000, 1400)] + [(k, k + 1) for k in range(2000, 2060)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: sets.find(x) for x in sets.up if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("per_member", [0, 8])
def test_links_in_buckets_miss_none(spark, per_member):
    rng = random.Random(4)
    members = sorted({(rng.randint(0, 5), rng.randint(0, 300)) for _ in range(500)})
    sets = Sets()
    for b, x in members:
        for c, y in members:
            if b == c and x < y <= x + 2:
                sets.join(x, y)
    df = spark.createDataFrame(members, "bucket int, id long")
    found = components.linked_in_buckets(df, lambda pairs: pairs.filter("v - u <= 2"), stars=2, pairs_per_member=per_member)
    assert {r["node"]: r["root"] for r in found.collect()} == {x: sets.find(x) for x in sets.up}


def test_crowded_buckets_are_split_without_losing_a_link(spark):
    rng = random.Random(6)
    members = sorted({(0, rng.randint(0, 2000)) for _ in range(400)})
    sets = Sets()
    for _, x in members:
        for _, y in members:
            if x < y <= x + 2:
                sets.join(x, y)
    seen = []

    def finer(rows):
        assert set(rows.columns) == {"bucket", "id", "comp", "this"}
        seen.append(rows.count())
        return rows.select(F.explode(F.array(F.expr("id div 8"), F.expr("(id + 4) div 8 + 10000"))).alias("bucket"), "id", "comp", "this")

    df = spark.createDataFrame([(b, x, x) for b, x in members], "bucket int, id long, place long")
    near = lambda one, other: F.abs(one["place"] - other["place"]) <= 2
    found = components.linked_in_buckets(df, lambda pairs: pairs, stars=1, pairs_per_member=1, may=near, finer=finer)
    assert seen and {r["node"]: r["root"] for r in found.collect()} == {x: sets.find(x) for x in sets.up}


def test_rare_shingles_bring_all_similar_lines_together(spark, prose):
    passage = prose(60, 3)
    rng = random.Random(8)
    lines = [f"{passage} {prose(rng.choice([5, 12, 15, 60]), k % 40)}" for k in range(120)] + [prose(3, k) for k in range(5)] + ["abc", "abcd"]
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = df.select(F.lit(1).alias("bucket"), "id", F.col("id").alias("comp"), F.struct("id").alias("this"))
    held = {}
    for r in fuzzy_lines.by_rare_shingles(rows, df).collect():
        held.setdefault(r["id"], set()).add(r["bucket"])
    of = [shingles(line) for line in lines]
    similar = apart = 0
    for i, a in enumerate(of):
        for j in range(i):
            if len(a & of[j]) >= 0.8 * len(a | of[j]):
                similar += 1
                assert held[i] & held[j]
            else:
                apart += not held[i] & held[j]
    assert similar > 500 and apart > 1500


def test_outlines_rule_out_no_similar_lines(spark, prose):
    rng = random.Random(14)
    pairs = [alike(prose, rng, size, 0.8, 0.82) for size in (20, 60, 300, 3000) for _ in range(40)]
    pairs += [(prose(60, 2 * k), prose(60, 2 * k + 1)) for k in range(40)] + [("a", "a"), ("abcdefgh", "abcdefgh")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy_lines.outline("a").alias("x"), fuzzy_lines.outline("b").alias("y"))
    as_struct = lambda c: F.struct(F.col(c)[0].alias("n"), *[F.col(c)[k + 1].alias(f"w{k}") for k in range(fuzzy_lines.PARITY_WORDS)])
    got = df.select("a", "b", F.col("x")[0].alias("n"), fuzzy_lines.may_be_similar(as_struct("x"), as_struct("y")).alias("may")).collect()
    for r in got:
        a, b = shingles(r["a"]), shingles(r["b"])
        assert r["n"] == len(a)
        assert r["may"] or len(a & b) < 0.8 * len(a | b)
    assert not any(r["may"] for r in got[160:200])


@pytest.mark.parametrize("step", [1, 11])
def test_masks_cover_every_pair_within_the_radius(step):
    rng = random.Random(1)
    tables = covering.masks(4, step=step)
    assert len(tables) == 31
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert any((a ^ b) & m == 0 for m in tables)


def print_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def near_by_hand(rows):
    prints = [(i, print_by_hand(t)) for i, t in rows]
    sets = Sets()
    for _, a in prints:
        for _, b in prints:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = {}
    for i, p in prints:
        root = sets.find(p)
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    return [(i, f"{p:016x}", least[sets.find(p)]) for i, p in prints]


def test_near_duplicates(spark, awkward, prose):
    rng = random.Random(9)
    rows = read(awkward)
    for k in range(40):
        words = prose(120, k % 5).split()
        words[rng.randrange(120)] = "changed"
        rows.append((100 + k, " ".join(words)))
    found = covering.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]))
    found = found.select("doc_id", covering.hex_digits("fp").alias("fp"), "component_id").collect()
    want = near_by_hand(rows)
    assert Counter(map(tuple, found)) == Counter(want)
    assert len({c for _, _, c in want}) < len(want) - 10


def test_near_dedup_keeps_one_of_each(awkward, nothing):
    kept = covering.near_dedup(awkward)
    assert kept.columns == awkward.columns
    # One row of each component stays; two components may have the same smallest doc_id, if rows of one id have other texts.
    rows = read(awkward)
    sets = Sets()
    for _, a in rows:
        for _, b in rows:
            if (print_by_hand(a) ^ print_by_hand(b)).bit_count() <= 4:
                sets.join(print_by_hand(a), print_by_hand(b))
    want = {}
    for i, t in rows:
        root = sets.find(print_by_hand(t))
        want[root] = min(((i is None, i or 0), want.get(root, (True, 1))))
    left = {}
    for i, t in read(kept):
        left.setdefault(sets.find(print_by_hand(t)), []).append((i is None, i or 0))
    assert left == {root: [least] for root, least in want.items()}
    assert covering.near_dedup(nothing).collect() == [] and covering.near_duplicates(nothing).collect() == []


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def shingles(line):
    return {line[k : k + 7] for k in range(max(1, len(line) - 6))}


def lines_by_hand(rows):
    """(doc_id, line_no, line) -> kept, for distinct (doc_id, text)."""
    rows = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    lines = [((no_id, i, k), normal(line), t) for no_id, i, t in rows for k, line in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]
    texts = sorted({line for _, line, _ in lines})
    sets = Sets()
    of = {text: shingles(text) for text in texts}
    holders = {}
    for text, parts in of.items():
        sets.find(text)
        for part in parts:
            holders.setdefault(part, []).append(text)
    for a, x in of.items():
        common = Counter(b for part in x for b in holders[part])
        for b, n in common.items():
            if n >= 0.8 * (len(x) + len(of[b]) - n):
                sets.join(a, b)
    lead = {}
    for at, line, _ in lines:
        root = sets.find(line)
        lead[root] = min(lead.get(root, at), at)
    return [(None if at[0] else at[1], at[2], None if lead[sets.find(line)][0] else lead[sets.find(line)][1], lead[sets.find(line)][2]) for at, line, _ in lines]


def line_rows(prose):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        words = prose(60, k % 6).split()
        if k % 3:
            words[rng.randrange(60)] = "other"
        rows.append((k, "\n".join([" ".join(words), "", prose(20, 1000 + k), "A common  line of every text." if k % 2 else "a common line of every text."])))
    return rows


def test_line_classes(spark, prose):
    rows = line_rows(prose) + [(500, None), (501, ""), (502, "\n \n"), (None, "one line\nof its own"), (503, "x"), (504, "x")]
    found = fuzzy_lines.line_classes(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(((r["doc_id"], r["line_no"], r["keep_doc"], r["keep_line"]) for r in found), key=repr) == sorted(lines_by_hand(rows), key=repr)
    assert sum(r["kept"] for r in found) == len({(r["keep_doc"], r["keep_line"]) for r in found})


def test_line_dedup_keeps_rows_and_other_lines(spark, prose, awkward, nothing):
    rows = line_rows(prose)
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    gone = {(i, k) for i, k, a, b in lines_by_hand(rows) if (i, k) != (a, b)}
    want = [(i, "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]
    out = fuzzy_lines.line_dedup(docs)
    assert out.columns == docs.columns and sorted(read(out)) == sorted(want)
    assert fuzzy_lines.line_dedup(awkward).count() == awkward.count()
    assert fuzzy_lines.line_dedup(nothing).collect() == []


def alike(prose, rng, size, low, high):
    """Two normal lines of about so many characters whose similarity is from low to high."""
    while True:
        left = prose(size // 4, rng.random())[:size].split(" ")
        right = list(left)
        while (j := len(shingles(" ".join(left)) & shingles(" ".join(right))) / len(shingles(" ".join(left)) | shingles(" ".join(right)))) > high:
            right[rng.randrange(len(right))] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
        if j >= low:
            return " ".join(left), " ".join(right)


@pytest.mark.parametrize("size", [60, 180, 250, 270, 600, 3000])
def test_similar_lines_share_a_band(spark, prose, size):
    rng = random.Random(size)
    pairs = [alike(prose, rng, size, 0.8, 0.85) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(fuzzy_lines.signature(F.col("a")), fuzzy_lines.signature(F.col("b"))).alias("met"))
    assert sum(r["met"] for r in df.collect()) >= 0.95 * len(pairs)


def test_lines_are_signed_past_the_beginnings_of_their_words(spark, prose):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    token = letters(1500)
    long_words = [letters(40) for _ in range(20)]
    broken = [w if k else " ".join([w[:2], w[2:4], w[4:6], w[6:8], w[8:10], w[10:12], w[12:14], w[14:16], w[16:18], w[18:20], w[20:22], w[22:24], w[24:]]) for k, w in enumerate(long_words)]
    assert len(long_words) < 24 and len(" ".join(broken).split()) >= 32
    lines = [
        " ".join(letters(2) for _ in range(40)) + " " + token, " ".join(letters(2) for _ in range(40)) + " " + token,  # one long token, other short words
        " ".join(long_words), " ".join(broken),  # few words and many
        "once more " * 40, "once more " * 41,  # the same words again and again
    ]
    rows = [(k, line) for k, line in enumerate(lines)]
    found = {r["doc_id"]: r["keep_doc"] for r in fuzzy_lines.line_classes(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert [(i, 0, found[i], 0) for i in range(len(lines))] == lines_by_hand(rows)
    assert found == {k: k // 2 * 2 for k in range(len(lines))}


def test_jaccard_is_exact(spark, prose):
    pairs = [("abcdefgh", "abcdefgx"), ("a", "a"), ("a", "b"), (prose(30, 1), prose(30, 1) + " more"), ("é" * 20, "é" * 9)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy_lines.jaccard(F.col("a"), F.col("b")).alias("j"))
    for r in df.collect():
        x, y = shingles(r["a"]), shingles(r["b"])
        assert r["j"] == pytest.approx(len(x & y) / len(x | y))


def test_sieve_loses_none(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    keys = rows.filter("k % 7 = 0")
    got = {r["k"] for r in fuzzy_lines.sieve(rows, keys, "k").collect()}
    assert {k for k in range(0, 5000, 7)} <= got and len(got) < 800


def test_open_buckets_are_listed_after_the_first_round(spark):
    """One round of stars, then all pairs that ``may`` leaves: no further rounds, no smaller buckets."""
    rng = random.Random(15)
    members = sorted({(rng.randint(0, 3), rng.randint(0, 900)) for _ in range(300)})
    sets = Sets()
    for b, x in members:
        for c, y in members:
            if b == c and x < y <= x + 2:
                sets.join(x, y)
    asked = []

    def similar(pairs):
        asked.append(pairs.count())
        return pairs

    def finer(rows):
        raise AssertionError("nothing is left to split")

    df = spark.createDataFrame([(b, x, x) for b, x in members], "bucket int, id long, place long")
    near = lambda one, other: F.abs(one["place"] - other["place"]) <= 2
    found = components.linked_in_buckets(df, similar, pairs_per_member=1, listed=200, may=near, finer=finer)
    assert len(asked) == 2 and sum(asked) <= len(members)
    assert {r["node"]: r["root"] for r in found.collect()} == {x: sets.find(x) for x in sets.up}


def test_lines_are_signed_and_compared_without_python(spark):
    df = spark.createDataFrame([(1, "one line", "another line")], "id long, a string, b string")
    each = df.select("id", fuzzy_lines.signature(F.col("a")), fuzzy_lines.outline("a"), fuzzy_lines.jaccard(F.col("a"), F.col("b")))
    rare = fuzzy_lines.by_rare_shingles(df.select(F.lit(1).alias("bucket"), "id"), df.select("id", F.col("a").alias("line")))
    for made in (each, rare):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())


def test_tables_are_signed_and_outlined_like_single_lines(spark, prose):
    lines = ["a", "abcdefg", "abcdefgh", "once more " * 40, "é" * 20, "\U0001F600 中文 and more", prose(300, 3), *(prose(k, k) for k in range(1, 60))]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("more", F.col("id") * 2)
    one = df.select("id", "more", fuzzy_lines.signature(F.col("line")).alias("bands"), fuzzy_lines.outline("line").alias("o")).collect()
    bands = {r["id"]: (r["more"], r["bands"]) for r in fuzzy_lines.signed(df, "id").collect()}
    outlines = {r["id"]: list(r)[1:] for r in fuzzy_lines.outlined(df).collect()}
    assert bands == {r["id"]: (r["more"], r["bands"]) for r in one} and outlines == {r["id"]: r["o"] for r in one}


def test_lines_are_signed_without_lambdas_and_moves(spark):
    lines = spark.createDataFrame([(1, "one line")], "key long, line string").repartition(3, "key")
    plan = fuzzy_lines.signed(lines)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and plan.count("Exchange") == 1 and "transform(" not in plan


def test_odd_white_space_still_counts_as_one_blank(spark):
    texts = ["A  b\tc\n\td \x0b e\r\n f\x0cg ", "a b c\nd e\nf g", "\t", "plain one", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.split(fuzzy_lines._normal(F.col("t")), "\n", -1)).collect()]
    assert [None if lines is None else [line.strip(" ") for line in lines] for lines in got] == [None if t is None else [normal(line) for line in t.split("\n")] for t in texts]


def test_long_lines_that_are_not_similar_are_told_apart_by_outlines(spark, prose):
    """Lines of 700 characters around a common passage (similarity 0.6 to 0.75): none of their pairs is left to be compared."""
    rng = random.Random(21)
    passage = prose(100, 1)[:560]
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(130)) + passage for _ in range(30)]
    pairs = [(a, b) for k, a in enumerate(lines) for b in lines[:k]]
    df = spark.createDataFrame(pairs, "a string, b string").select(fuzzy_lines.outline("a").alias("x"), fuzzy_lines.outline("b").alias("y"))
    as_struct = lambda c: F.struct(F.col(c)[0].alias("n"), *[F.col(c)[k + 1].alias(f"w{k}") for k in range(fuzzy_lines.PARITY_WORDS)])
    assert all(0.6 < len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.75 for a, b in pairs)
    assert df.filter(fuzzy_lines.may_be_similar(as_struct("x"), as_struct("y"))).count() <= 0.02 * len(pairs)


def test_small_and_large_tables_of_edges_have_the_same_components(spark, monkeypatch):
    rng = random.Random(22)
    edges = spark.createDataFrame([(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)], "u long, v long")
    small = {tuple(r) for r in components.components(edges).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert small == {tuple(r) for r in components.components(edges).collect()}


def test_groups_that_a_round_joins_are_not_listed(spark):
    """Members that are one component by then give no pairs: the second round's pairs follow the number of components."""
    members = [(0, k) for k in range(300)] + [(0, 1000 + k) for k in range(10)]
    sets = Sets()
    for _, x in members:
        sets.join(x, 0 if x < 1000 else x)
    asked = []

    def similar(pairs):
        asked.append(pairs.count())
        return pairs.filter("v < 1000")

    df = spark.createDataFrame(members, "bucket int, id long")
    found = components.linked_in_buckets(df, similar, stars=1, pairs_per_member=1, listed=1, later=12)
    assert {r["node"]: r["root"] for r in found.collect()} == {x: 0 for x in range(300)}
    assert asked[0] == 309 and len(asked) == 2 and asked[1] == 300 * 10 + 45


def test_fingerprints_are_summed_without_python(spark, prose):
    odd = ["ÄPFEL Äpfel ẞ İ I J K\u0085L \x1cM", "A", "a B\tc", "one Two\x0bthree\x0cFOUR\r\nfive ", " \n", "", None, "É A É A É A É A É A", prose(70000, 3), "Ⅰ Ⓐ Ω WORD"]
    rows = [(k, text, "s") for k, text in enumerate(odd + [prose(k, k) for k in range(1, 12)])]
    found = covering.fingerprints(frame(spark, rows))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    got = found.select("doc_id", covering.hex_digits("fp").alias("fp")).collect()
    assert sorted(map(tuple, got)) == [(k, f"{print_by_hand(text):016x}") for k, text, _ in rows]


def test_rounds_read_no_more_than_the_nodes_between(spark, monkeypatch):
    """A group whose members are all linked goes into the rounds with an edge per node, not with its square."""
    edges = [(a, b) for a in range(80) for b in range(a)] + [(100 + k, 100) for k in range(1, 50)] + [(200, 100), (200, 79), (300, 301), (302, 301)]
    read, rooted = [], components._rooted

    def counted(core):
        read.append(core.count())
        return rooted(core)

    monkeypatch.setattr(components, "_rooted", counted)
    found = sorted(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == [(k, 0) for k in [*range(80), *range(100, 150), 200]] + [(k, 300) for k in range(300, 303)]
    assert read[0] <= 160 < len(edges)


def test_near_dedup_runs_no_python(spark, awkward):
    plan = covering.near_dedup(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_shingle_meets_its_own_band_and_word_only(spark):
    lines = spark.createDataFrame([(b"k", 1, "a line to be signed")], "key binary, id long, line string")
    of = lambda df, call: max(line.count(call) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert of(fuzzy_lines.signed(lines), "min(") == fuzzy_lines.ROWS
    assert of(fuzzy_lines.outlined(lines.select("id", "line")), "bit_xor(") == 1


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Neither the rows of all masks nor those of the second family meet by way of the driver, however small Spark takes them for."""
    rng = random.Random(21)
    base = rng.getrandbits(62)
    prints = sorted({base ^ sum(1 << bit for bit in rng.sample(range(62), 4)) for _ in range(150)} | {rng.getrandbits(62) for _ in range(150)})
    plans = {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return landed(df, name)

    landed = covering.landed
    monkeypatch.setattr(covering, "landed", seen)
    monkeypatch.setattr(components, "landed", seen)
    monkeypatch.setattr(covering, "linked_in_buckets", functools.partial(components.linked_in_buckets, stars=0, pairs_per_member=0))
    found = {(r["node"], r["root"]) for r in covering.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    for name in ("members", "links"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name
    assert "finer" in plans
    sets = Sets()
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            sets.join(a, b)
    assert found == {(x, sets.find(x)) for x in sets.up}
    assert len(found) > 100
