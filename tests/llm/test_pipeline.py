"""The corpus pipeline against plain Python, stage by stage, and odd inputs of every stage."""

import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import bpe, common, langid, simhash
from tests.llm.test_text import BYTE, public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"en": ["the", "house", "of", "water", "and", "stone", "went", "over"], "de": ["das", "haus", "und", "wasser", "ging", "\u00fcber", "stein", "nicht"]}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(n))
    rows = [(i, make(lang := "en" if i % 3 else "de", rng.randint(5, 300)), lang, "xyz"[i % 3] if i % 7 else None, 9) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3], 9) for i in range(0, 20, 2)]  # exact copies
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "x", 9) for i in range(0, 30, 3)]
    rows += [(300, None, "en", "x", 0), (301, "", "en", "x", 0), (302, "12 34 !", "de", None, 7), (303, "\u6f22\u5b57 " * 9, None, None, None)]
    rows += [(None, make("en", 40), "en", "x", 9), (None, make("en", 50), None, None, None), (None, rows[4][1], "en", "x", 9)]
    rows += [rows[5], rows[5], (5, make("de", 30), "de", "y", 9), (400, make("en", 4000), "en", "z", 9)]
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=key)


def test_stages_against_plain_python(spark, data):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", lang_pred string, kept int")
    got = corpus_pipeline.language_id(spark, docs, data)
    model = langid.train(docs.select("doc_id", "text", "lang"), order=F.xxhash64("doc_id"))
    want = [r for r, (lang, share) in zip(rows, model.predict([r[1] for r in rows])) if lang != "und" and share >= 0.5]
    assert plain(got.collect()) == plain(want) and 300 not in {r[0] for r in want}

    docs = spark.createDataFrame(want, SCHEMA)
    groups = defaultdict(list)
    for r in want:
        groups[r[1]].append(r)
    after = []
    for g in groups.values():
        ids = [r[0] for r in g if r[0] is not None]
        after.append(min((r for r in g if r[0] == min(ids)), key=key) if ids else min(g, key=key))
    got = corpus_pipeline.exact_dedup(spark, docs, data).collect()
    assert plain(got) == plain(after)

    docs = spark.createDataFrame(after, SCHEMA)
    prints = [simhash.fingerprint(r[1]) % (1 << 64) for r in after]
    root = list(range(len(after)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(after)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(after):
        groups[find(i)].append(r)
    want = []
    for g in groups.values():
        least = min((r[0] for r in g if r[0] is not None), default=None)
        want += [r for r in g if r[0] == least]
    got = corpus_pipeline.near_dedup(spark, docs, data).collect()
    assert plain(got) == plain(want)

    docs = spark.createDataFrame(want, SCHEMA)
    got = corpus_pipeline.mixing_sources(spark, docs, data).collect()
    assert {tuple(r) for r in got} <= set(want)
    times = defaultdict(int)
    for r in got:
        times[tuple(r)] += 1
    assert max(times.values()) <= 3
    size, taken = defaultdict(int), defaultdict(int)
    for r in want:
        size[r[3]] += len(r[1].split())
        taken[r[3]] += len(r[1].split()) * times[r]
    total, sources = sum(size.values()), sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    full = set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        over = {s for s in sources if target[s] > 3 * size[s] and s not in full}
        if not over:
            break
        full |= over
    for s in sources:
        assert taken[s] == pytest.approx(target[s], rel=0.35), s  # whole documents, the largest of which holds a fifth of its source
    assert plain(got) == plain(corpus_pipeline.mixing_sources(spark, docs.repartition(5), data).collect())

    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.byte_bpe(spark, spark.createDataFrame(want, SCHEMA), data).collect():
        assert r.token_ids in [reference.encode_ordinary(w[1] or "") for w in want if w[0] == r.doc_id]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_inputs(spark, data, name, stage):
    empty = spark.createDataFrame([], SCHEMA + ", size long")
    assert stage(spark, empty, data).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(1, None, None, "s", 1), (1, "", "en", None, 0), (2, "one two three", "en", "s", 13), (2, "one two three", "en", "s", 13), (2, "other words here", "en", "s", 2)]
    out = stage(spark, spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", size long, fingerprint string"), data)
    assert name == "byte_bpe" or out.columns == list(corpus_pipeline.COLUMNS)
    assert out.count() == {"language_id": 3, "exact_dedup": 3, "simhash_near_dedup": 3, "byte_bpe": 8}.get(name, out.count())
    if name == "mixing":
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(2, "one two three"), (2, "other words here")}


def test_an_operator_forgets_when_another_takes_its_worker():
    """Workers are used again: what byte_bpe or language_id remember mustn't stay beside the next stage."""
    encoder = bpe.load(BYTE, public_tokenizers.PATTERN)
    assert bpe.load(BYTE, public_tokenizers.PATTERN) is encoder
    common.take_turn("langid")
    assert not bpe._loaded
    again = bpe.load(BYTE, public_tokenizers.PATTERN)
    assert again is not encoder and again.packed("the house, wasser") == encoder.packed("the house, wasser")

    model = langid.Model(["de", "en"], ["<", ">", "a", "b", "ab"], np.log(np.array([[5, 5], [5, 5], [1, 6], [6, 1], [2, 2], [1, 1]], np.float32)), {"Latin": [0, 1]})
    first = model.predict(["aa bb", "a b ab", None, "12"])
    assert model.cache
    model.forget()
    assert not model.cache and not hasattr(model, "rows") and model.predict(["aa bb", "a b ab", None, "12"]) == first


def test_byte_bpe_remembers_within_its_room(spark, data, monkeypatch):
    """The pipeline's last stage works beside JVMs that earlier stages made large: it has less room than the operator, and the same ids."""
    rooms = []
    monkeypatch.setattr(bpe, "encode", lambda *a, room=None, **b: rooms.append(room))
    corpus_pipeline.byte_bpe(spark, None, data)
    assert rooms == [corpus_pipeline.WORDS] and corpus_pipeline.WORDS < bpe.REMEMBERED

    texts = [" ".join(f"w{i * 7919 % 5003}x{i}" for i in range(k, k + 400)) for k in range(0, 4000, 200)]
    small, large = bpe.Bpe(BYTE, public_tokenizers.PATTERN, 40_000), bpe.Bpe(BYTE, public_tokenizers.PATTERN)
    assert [small.packed(t) for t in texts] == [large.packed(t) for t in texts]
    assert small.used <= 20_000 + bpe.OBJECTS * 2 + 200 and len(small.chunks) + len(small.older) < len(large.chunks) / 5


def test_simhash_tables_go_when_another_takes_its_worker():
    common.take_turn("simhash", simhash.forget)
    got = simhash.anchors(np.array([5, -9], np.int64), 2)
    assert simhash.syndromes.cache_info().currsize
    common.take_turn("bpe")
    assert not simhash.syndromes.cache_info().currsize and not simhash.cosets.cache_info().currsize
    assert all((a == b).all() for a, b in zip(got, simhash.anchors(np.array([5, -9], np.int64), 2)))


def test_near_dedup_computes_fingerprints_once_a_row(spark, data):
    """Beside the operator's own, which are written: a second computation in a task would take a second worker."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = corpus_pipeline.near_dedup(spark, docs, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("fingerprints(") == 1, plan
