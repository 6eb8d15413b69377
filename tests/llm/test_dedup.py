"""Exact and near duplicates and passages, against brute force."""

import hashlib
import inspect
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.llm import common, exact, passages, simhash
from basalt.llm.common import Scratch, lookup
from basalt.llm.components import connected_components

DOCS = "doc_id long, text string, key string, n long"


def frame(spark, rows):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 9) for i, t in rows], DOCS)


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200_000), (6, "b" * 200_000), (7, "é"), (None, "a"), (2, "a"), (8, "A")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.groups(frame(spark, rows), keep="largest").collect()}
    assert got == {(1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True), (8, 8, 1, True)}
    small = exact.groups(frame(spark, rows)).filter("doc_id = 7").first()
    assert small.text_sha256 == hashlib.sha256("é".encode()).hexdigest()
    assert exact.groups(frame(spark, [])).count() == 0


def test_exact_groups_when_all_hashes_collide(spark):
    rows = [(i, f"t{i % 3}") for i in range(12)]
    got = exact.groups(frame(spark, rows), digest=lambda c: F.unhex(F.lit("00"))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 3, 4) for i in range(12)}


def test_exact_groups_normalise(spark):
    got = exact.groups(frame(spark, [(1, "A b"), (2, "a b")]), normalise=lambda c: F.lower(c)).collect()
    assert {r.keep_id for r in got} == {1}


def test_lookup_with_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = lookup(rows, found, "k", "n", 5000)
    assert got.count() == 5000 and got.filter("v <> k * 2 or v is null").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark)).collect()}
    alone = {i for i in root if not any(a != b and i in (a, b) for a, b in pairs)}
    assert got == {i: c for i, c in root.items() if i not in alone}


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\t\n ", max_size=40))
def test_fingerprints(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    start, n, e, over = simhash.cosets()
    assert n.sum() == 44552 and ((over == 0) & (n.sum() > 0)).sum() == 2048 and len(set(np.bincount(np.repeat(np.arange(2048), n)[over == 0]))) == 1


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_anchors_bring_near_pairs_together(threshold):
    rng = random.Random(threshold)
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), threshold):
            b ^= 1 << k
        fps = np.array([a, b], np.uint64).view(np.int64)
        row, anchor, own = simhash.anchors(fps, threshold)
        order = np.lexsort((~own, anchor))
        found = [len(x) for x, _ in simhash.compare(anchor[order], fps[row[order]], own[order], threshold)]
        assert bool(found) == (threshold > 0)


def test_component_ids_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.choice([1, 2, 5, 60]))
        rows.append((3 * i + 5, " ".join(text)))
        for _ in range(rng.choice([0, 0, 1])):
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((3 * i + rng.choice([4, 6]), " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "w1 w2"), (5, rows[0][1])]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(12):
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), c in zip(rows, root):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i is None, i or 0, f"{f:016x}", least.get(c, -1)) for (i, _), f, c in zip(rows, fps, root))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.component_ids(frame(spark, rows)).collect())
    assert got == want
    assert simhash.component_ids(frame(spark, [])).count() == 0


def test_compact_windows_against_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, least = int(rng.integers(1, 40)), int(rng.integers(2, 9))
        s = rng.integers(0, 1 << 60, n).astype(np.uint64)
        cut = sorted({0, n, *rng.integers(0, n, 2).tolist()})
        starts, ends = np.array(cut[:-1]), np.array(cut[1:])
        c, l, r, value = passages.compact(s, starts, ends, least, 1)
        got = {(a, b): i for i, lo, hi in zip(c.tolist(), l.tolist(), r.tolist()) for a in range(lo, i + 1) for b in range(i, hi + 1)}
        v = passages.mix(s + np.uint64(2 * 0x9E3779B97F4A7C15 % (1 << 64)))
        for lo, hi in zip(cut, cut[1:]):
            for a in range(lo, hi):
                for b in range(a + least - 1, hi):
                    assert got[a, b] == a + int(v[a : b + 1].argmin())


def test_passages(spark):
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(100000)}" for _ in range(n)]
    common, other = words(60), words(120)
    edited = list(other)
    edited[40] = "changed"
    rows = [
        (1, " ".join(words(80) + common + words(30))), (2, " ".join(words(10) + common)), (3, " ".join(common + words(200))),
        (4, " ".join(words(25) + other)), (5, " ".join(edited + words(25))),
        (6, " ".join(words(400))), (7, " ".join(common[:40] + words(60))), (8, None), (9, ""), (10, "short"), (11, "short"), (None, " ".join(common)),
    ]
    rows += [(12, rows[5][1]), (12, rows[5][1])]
    got = passages.near_passages(frame(spark, rows)).collect()
    pairs = {(r.doc_id, r.other_id) for r in got}
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 12}
    assert {(4, 5), (5, 4), (6, 12), (12, 6)} <= pairs and {(1, 2), (1, 3)} & pairs or {(2, 1), (3, 1)} & pairs
    one = next(r for r in got if (r.doc_id, r.other_id) == (4, 5))
    assert (one.start_word, one.n_words, one.other_start, one.copy) == (25, 120, 0, False) and 0.9 < one.similarity < 1
    assert passages.near_passages(frame(spark, [])).count() == 0


def test_no_pair_with_a_common_passage_is_lost(spark):
    """All pairs of few documents; of many that share a passage a row for each that tells which words."""
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(100000)}" for _ in range(n)]
    few, many = words(70), words(56)
    rows = [(i, " ".join(words(30) + few[i % 3 * 8 : i % 3 * 8 + 54] + words(30))) for i in range(20)]
    rows += [(100 + i, " ".join(words(i % 40) + many[i % 2 * 3 : i % 2 * 3 + 53] + words(40))) for i in range(passages.GROUP + 16)]
    got = passages.near_passages(frame(spark, rows)).collect()
    pairs, members = {(r.doc_id, r.other_id) for r in got}, {}
    for r in got:
        if r.member:
            x, y = (rows[i if i < 20 else i - 80][1].split() for i in (r.doc_id, r.other_id))
            assert x[r.start_word : r.start_word + r.n_words] == y[r.other_start : r.other_start + r.other_words] and r.n_words >= 50
            members.setdefault(r.doc_id, []).append((r.other_id, r.other_start, r.other_start + r.other_words))
    for i in range(20):
        for j in range(20):
            assert i == j or abs(i % 3 - j % 3) > 1 or (i, j) in pairs
    assert members
    for i, _ in rows[20:]:
        for j, _ in rows[20:]:
            both = [(x, y) for x in members.get(i, []) for y in members.get(j, []) if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= 50]
            assert i == j or (i, j) in pairs or both


def test_alignment_needs_no_link_in_each_run():
    words = [f"w{i}" for i in range(54)]
    edited = [*words[:45], "changed", *words[46:]]
    x, y = (passages.shingles(passages.words(" ".join(w)), 5) for w in (words, edited))
    assert passages.align(x, y, [(3, 3)], 5, 50, 0.8) == [(0, 54, 0, 54, 45 / 55)]


def test_alignment_against_all_windows():
    rng, least, width = random.Random(5), 12, 3
    span = least - width + 1

    def jaccard(u, v):
        return len(u & v) / len(u | v)

    def windows(x):
        return [set(x[i:j].tolist()) for i in range(len(x)) for j in range(i + span, len(x) + 1)]

    similar = 0
    for t in range(150):
        a = [f"w{rng.randrange(30 if t % 3 == 0 else 10000)}" for _ in range(rng.randrange(13, 22))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = [f"z{t}{i}"] * rng.randrange(2) if len(b) > least else [f"z{t}{i}"]
        b = [f"y{i}" for i in range(rng.randrange(6))] + b
        x, y = (passages.shingles(passages.words(" ".join(w)), width) for w in (a, b))
        equal = [(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]]
        if not equal:
            continue
        got = passages.align(x, y, [rng.choice(equal)], width, least, 0.8)
        best = max((jaccard(u, v) for u in windows(x) for v in windows(y)), default=0)
        assert bool(got) == (best >= 0.8), (a, b)
        similar += best >= 0.8
        for p, n, q, m, s in got:
            u, v = set(x[p : p + n - width + 1].tolist()), set(y[q : q + m - width + 1].tolist())
            assert min(n, m) >= least and p + n <= len(a) and q + m <= len(b) and s == jaccard(u, v) >= 0.8
    assert 50 < similar < 150


def test_chance_that_windows_meet():
    p = inspect.signature(passages.near_passages).parameters
    n, k, s = (p[name].default for name in ("hashes", "agree", "similarity"))
    assert sum(math.comb(n, i) * s**i * (1 - s) ** (n - i) for i in range(k, n + 1)) > 0.99


def test_repeated_lines_give_one_passage():
    line = [f"w{i}" for i in range(12)]
    x = passages.shingles(passages.words(" ".join(line * 20)), 5)
    assert passages.align(x, x.copy(), [(0, 0), (12, 24)], 5, 50, 0.8) == [(0, 240, 0, 240, 1.0)]


def test_texts_of_a_cell_beyond_the_bound_are_in_a_file(monkeypatch):
    monkeypatch.setattr(passages, "KEPT", 100)
    rng, texts = np.random.default_rng(2), passages.Texts()
    for _ in range(2):
        want = {i: rng.integers(0, 1 << 60, n).astype(np.uint64) for i, n in enumerate([60, 70, 0, 30, 500])}
        for i, x in want.items():
            texts[i] = x
        assert list(texts.held) == [0, 2, 3] and all((texts[i] == x).all() and len(texts[i]) == len(x) for i, x in want.items())
        texts.clear()


def test_marked_rows(spark):
    rows = spark.range(2000).withColumn("text", F.lit("x"))
    keys = spark.range(0, 4000, 7)
    got = {r.id for r in common.marked(rows, keys, "id").collect()}
    assert set(range(0, 2000, 7)) <= got and len(got) < 300
    assert common.marked(rows, keys.limit(0), "id").count() == 0


def test_passages_of_repeated_rows_and_of_texts_with_one_id(spark):
    """Repeated rows count once; different texts of one id all take part, also in large classes."""
    rng = random.Random(13)
    words = lambda n: [f"v{rng.randrange(100000)}" for _ in range(n)]
    one, two, many = words(60), words(60), words(56)
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(words(9) + one)), (3, " ".join(two + words(9))), (2, None)]
    rows += [(100 + i, " ".join(words(i % 40) + many + words(40))) for i in range(passages.GROUP + 16)]
    rows += [(170, " ".join(words(300) + many)), rows[2], rows[2], rows[9], rows[9]]
    got = [tuple(r) for r in passages.near_passages(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and {(1, 2), (1, 3)} <= {r[:2] for r in got}


def test_home_of_pairs():
    """Keys of many rows come first, those of over SLOT rows last, and one key has one home."""
    keys = np.array([-5, 1 << 40, 77 << 50, 12], np.int64)
    small, large, most, over = passages.home(keys, np.array([2, 60, passages.SLOT, passages.SLOT + 1])).tolist()
    assert most < large < small < over
    assert len(set(passages.home(np.repeat(keys, 3), np.full(12, 9)).tolist())) == 4


def test_sweep_deletes_shuffles_of_ended_writes(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\w+\.data", disk.getAllFiles().toString()))
    before, scratch = held(), Scratch(spark)
    kept = scratch.keep(spark.range(1000).repartition(3, "id"))
    made = held() - before
    until = time.time() + 20
    while made & held() and time.time() < until:
        scratch.sweep()
        time.sleep(0.2)
    assert made and not made & held() and kept.count() == 1000


def test_places_of_shingles_that_differ_in_low_bits_only():
    """Places are sorted along in the low bits; shingles that are equal above these must still come out in order."""
    rng = random.Random(4)
    for values in ([7, 6, 5, 4], [1 << 40, (1 << 40) + 1, 9], [1 << 63, 3 << 60]):
        x = np.array([rng.choice(values) for _ in range(50)], np.uint64)
        got = passages.Places(x)
        assert got.at.tolist() == sorted(range(len(x)), key=lambda i: (int(x[i]), i))
        assert got.different.tolist() == sorted(set(x.tolist()))
    text = "Ab  cé\t漢  x\n"
    assert len(passages.words(text)) == 4 and (passages.words(text) == np.concatenate([passages.words(w) for w in text.split()])).all()
