"""Language ID, quality, byte BPE, token files, URL filters, mixing, neighbours, pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm import ann, bpe, langid, mixing, quality, registry, tokenfile, urlfilter
from basalt.llm.common import Scratch

BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)
ODD = [None, "", " ", "\n\n  x", "it's  a\ttest　of 123 ½ café́ 漢字 <|endoftext|>", "a" * 3000, "\U0001f600" * 50]


def plain(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(BYTE, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abthe ING'sré́一 \n\t\x1c\x85\xa0 12½!?\U0001f600"), max_size=60))
def test_bpe_as_tiktoken(reference, encoder, text):
    ids = np.frombuffer(encoder.packed(text), "<u4")
    assert ids.tolist() == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 60), st.binary(max_size=8))
def test_prefixes_append_and_edit(encoder, data, a, b, more):
    lo, hi = sorted((a % (len(data) + 1), b % (len(data) + 1)))
    p = bpe.Prefixes(encoder, data[:lo])
    p.append(data[lo:])
    assert p.last == bpe.Prefixes(encoder, data).last
    p.replace(lo, hi, more)
    assert p.ids() == bpe.Prefixes(encoder, data[:lo] + more + data[hi:]).ids()


def test_bpe_operator(spark, reference):
    out = {r.doc_id: r for r in bpe.encode(plain(spark, ODD), BYTE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = reference.encode_ordinary(t or "")
        assert out[i].token_ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.encode(plain(spark, ODD), BYTE, public_tokenizers.PATTERN).select("doc_id", bpe.decode(F.col("token_ids"), BYTE, public_tokenizers.PATTERN).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcEÉé́̇İΣ1漢'’.,;:!?*%&$#-<|>_ \n\t\r\x0b\x1c\x85", "don't", "'re", "<|endoftext|>"]), max_size=30).map("".join), max_size=4))
def test_tokenize_by_chunks(texts):
    """The library as it is, with no switch: special tokens' strings get those tokens' ids."""
    ids, n = tokenfile.tokenizer(WORD).tokenize(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []
    assert got == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokenize_special_tokens_and_memory(monkeypatch):
    ids = lambda x: tokenfile.tokenizer(WORD).tokenize(pa.array([x]))[0].tolist()
    assert ids("hello <|endoftext|> world") == [3306, 49407, 1002]
    encoder = tokenfile.Encoder(WORD)
    monkeypatch.setattr(tokenfile, "REMEMBERED", 2000)
    text = " ".join(f"word{i}. Letters{chr(97 + i)} {'x' * 300}" for i in range(26))
    for _ in range(3):
        assert encoder.tokenize(pa.array([text, None]))[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert encoder.used <= 2000 and all(len(c) <= tokenfile.LONGEST for c in encoder.known)


def test_words_are_kept_as_numbers_and_ascii_ones_go_to_the_model():
    """Ids that a worker remembers stand in arrays, and words of a-z skip what the library does before its model."""
    encoder = tokenfile.Encoder(WORD)
    words = [w for i in range(300) for w in (f"{chr(97 + i % 26)}qz{chr(97 + i % 25)}" * (1 + i % 40), f"\u00fcber{chr(97 + i % 26)}")]
    for how in (True, False):
        encoder.bare = how
        ids, n = encoder.words(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    encoder = tokenfile.Encoder(WORD)
    assert encoder.bare
    first = encoder.tokenize(pa.array([" ".join(words)]))[0].tolist()
    assert set(map(type, encoder.known.values())) == {int} and encoder.count == len(encoder.known)
    assert encoder.tokenize(pa.array([" ".join(words[::-1]), " ".join(words)]))[0].tolist()[-len(first) :] == first


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_grammar_round_trip(docs):
    counts = np.array([len(d) for d in docs])
    g = tokenfile.compress(np.array([x for d in docs for x in d], "<u4"), counts, 10, least=2)
    g, ids = tokenfile.unpack(tokenfile.pack(g, [None, *range(1, len(docs))]))
    assert ids == [None, *range(1, len(docs))]
    assert [g.document(k).tolist() for k in range(len(docs))] == docs
    assert all(g.document(k, lo, lo + 5).tolist() == docs[k][lo : lo + 5] for k in range(len(docs)) for lo in range(0, len(docs[k]), 3))
    rest = [g.sequence[a:b].tolist() for a, b in zip(g.starts, [*g.starts[1:], len(g.sequence)])]
    assert all(rest.count(p) < 4 for d in rest for p in zip(d, d[1:]))
    whole = g.expand(g.sequence)
    assert whole.tolist() == [x for d in docs for x in d] and all(g.lengths[r] == len(g.expand(np.array([g.first + r], np.uint32))) for r in range(len(g.left)))


def test_token_files(spark):
    texts = [*ODD, *["the same words again and again " * 40] * 5]
    docs = plain(spark, texts).union(spark.createDataFrame([(None, "null id", "x"), (3, "again", "x")], "doc_id long, text string, token_ids string"))
    path = Scratch(spark).new()
    tokenfile.write(docs, WORD, path, 2, shard=200)
    got = tokenfile.read(spark, path, ids=True).orderBy("start").collect()
    t = LIBRARY
    at = 0
    assert [r.doc_id for r in got] == [None, *sorted([*range(len(texts)), 3])]
    some = tokenfile.fetch(spark, path, [3, 5, 10**6]).collect()
    assert sorted((r.doc_id, r.token_ids) for r in some) == sorted((r.doc_id, r.token_ids) for r in got if r.doc_id in (3, 5))
    assert tokenfile.fetch(spark, path, []).count() == 0
    for r in got:
        options = [x or "" for i, x in [*enumerate(texts), (None, "null id"), (3, "again")] if i == r.doc_id]
        ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in options]
        assert r.token_ids in ids and r.start == at and r.n_tokens == len(r.token_ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        at += r.n_tokens
    assert spark.read.parquet(path).count() > 3
    empty = Scratch(spark).new()
    tokenfile.write(docs.limit(0), WORD, empty, 2)
    assert tokenfile.read(spark, empty).count() == 0


def test_one_document_alone():
    """A document is read without other documents' symbols, and without rules that it doesn't use."""
    docs = [[1, 2, 3, 4] * 8, [5, 6] * 20, [1, 2] * 9]
    g = tokenfile.compress(np.array(sum(docs, []), "<u4"), np.array([len(d) for d in docs]), 10)
    used, todo = set(), set(g.sequence[g.starts[1] : g.starts[2]].tolist())
    while todo:
        x = todo.pop()
        if x >= g.first:
            used.add(x)
            todo |= {int(g.left[x - g.first]), int(g.right[x - g.first])}
    g.sequence = g.sequence.copy()
    g.sequence[: g.starts[1]] = g.sequence[g.starts[2] :] = 99_999
    for r in range(len(g.left)):
        if r + g.first not in used:
            g.left[r] = g.right[r] = 99_999
    assert g.document(1).tolist() == docs[1] and g.document(1, 7, 12).tolist() == docs[1][7:12]


def test_language_spans_and_ties(spark):
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(60))
    a, b = ["ka", "lo", "mi", "nu"], ["est", "ion", "que", "eau"]
    rows = [(make(a), "aa") for _ in range(30)] + [(make(b), "bb") for _ in range(20)] + [("привет мир и люди", "ru"), (None, "aa"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["aa", "bb", "ru"] and model.scripts["Cyrillic"] == [2]
    mixed = make(a) + " " + make(b)
    got = langid.predict(plain(spark, [make(a), make(b), "мир", None, "123 !", mixed, make(a) * 200, "漢字"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["aa", "bb", "ru", "und", "und", got[5].lang_pred, "aa", "aa"]
    assert [r.score for r in got[:5]] == [1, 1, 1, 0, 0] and 0.4 < got[5].score < 0.65 and got[7].score == 0
    spans = [(r.first_word, r.n_words, r.lang) for r in langid.spans(plain(spark, [mixed]), model).collect()]
    assert spans == [(0, 60, "aa"), (60, 60, "bb")]
    assert langid.train(spark.createDataFrame([], "text string, lang string")) is None
    assert [r.lang_pred for r in langid.predict(plain(spark, ["a"]), None).collect()] == ["und"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = langid.Model(["a", "b", "c"], [], np.zeros((1, 3), np.float32), {"Latin": [0, 1, 2]}, penalty=1.5)
        n = int(rng.integers(1, 6))
        words = [f"w{chr(97 + i)}" for i in range(n)]
        scores = {w: rng.normal(size=3).astype(np.float32) for w in words}
        m.score = lambda found: np.stack([scores[w] for w in found])  # noqa: B023
        path = m.label([" ".join(words)])[0][1].tolist()
        value = lambda p: sum(scores[w][k] for w, k in zip(words, p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(np.ndindex(*[3] * n), key=value)
        assert value(path) == pytest.approx(value(best), abs=1e-4)


def test_held_out_language_and_quality(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = registry.op2_language_id(spark, data).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = registry.op7_quality(spark, data).join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert got > 0.9


def test_quality_rules(spark):
    rng = random.Random(0)
    good = lambda: " ".join(f"word{rng.randrange(500)}" for _ in range(50))
    rows = [(i, good() if i % 3 else good().upper() + "!!!", "x", 1) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "x", 1), (901, "", "x", 1), (None, "y", "x", 1)], "doc_id long, text string, score string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(1, None), (None, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 60
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 203 and all((got[i] > 0.5) == (i % 3 > 0) for i in range(150, 200)) and all(0 <= s <= 1 for s in got.values())
    stats = [c.alias(k) for k, c in quality.statistics(F.col("text")).items()]
    x = docs.select("doc_id", *stats).toPandas()
    names = list(quality.statistics(F.col("text")))
    z = model.bias + sum(r.weight * r.holds(x[names].to_numpy(float), names) for r in model.rules)
    assert np.allclose(1 / (1 + np.exp(-z)), [got[None if np.isnan(i) else int(i)] for i in x.doc_id])
    assert quality.train(docs, labels.limit(0)).rules == []


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left, total = {}, set(names), float(sum(sizes.values()))
    while True:
        share = (total - sum(full.values())) / (sum(w[s] for s in left) or 1)
        over = {s for s in left if share * w[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: full.get(s, share * w[s] if s in left else 0.0) for s in names}
        full |= {s: cap * sizes[s] for s in over}
        left -= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 30, 900]))), rng.choice(["a", "b", "c", "d", "d", "d", None, "é"])) for i in range(300)]
    rows += [(None, "one two", "a"), (7, rows[7][1], rows[7][2]), (400, None, "zero"), (401, "tiny one", "tiny"), (402, "x\x0by\x1cz w", "a")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size int, key string")
    got = mixing.mix(docs).rows.collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).rows.collect()))
    size = lambda t: len([w for w in __import__("re").split("[ \t-\r]+", t or "") if w])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, source = brute_targets(sizes), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        if sizes[s] > 2000:
            assert taken[s] == pytest.approx(want[s], rel=0.05), s
    assert mixing.mix(docs.limit(0)).rows.count() == 0


def test_mixing_slots_run_through_all_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * 700, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    m = mixing.mix(docs, shard=64)
    n = {r.key: r.n_blocks for r in m.sources.collect()}
    for key, rows in ((k, [r for r in m.slots.collect() if r.key == k]) for k in n):
        times = np.bincount([r.block for r in rows], minlength=n[key])
        assert times.max() - times.min() <= 1 and times.max() <= 3
    assert m.slots.groupBy("shard").count().agg(F.max("count")).first()[0] <= 66


def test_permutations_of_indices(spark):
    sizes = [*range(1, 40), 331, 1024, 5000]
    rows = [(k, n) for n in sizes for k in ("=a", "=b")]
    slots = spark.createDataFrame(rows, "key string, n_blocks long").select("*", F.explode(F.expr("sequence(0l, 2 * n_blocks - 1)")).alias("j"))
    orders = {}
    for r in mixing.permuted(slots, 0).orderBy("key", "n_blocks", "j").collect():
        orders.setdefault((r.key, r.n_blocks, r.j // r.n_blocks), []).append(r.block)
    assert all(sorted(v) == list(range(k[1])) for k, v in orders.items())
    for n in (331, 1024, 5000):
        four = [orders[k, n, t] for k in ("=a", "=b") for t in (0, 1)]
        assert len({tuple(v) for v in four}) == 4
        for v in four:
            steps = [(y - x) % n for x, y in zip(v, v[1:])]
            assert max(steps.count(d) for d in set(steps)) < n / 20  # far from an affine map
            assert abs(np.corrcoef(range(n), v)[0, 1]) < 0.2
    huge = spark.createDataFrame([("=a", 10**12, j) for j in (0, 1, 10**12 - 1, 2 * 10**12)], "key string, n_blocks long, j long")
    assert all(0 <= r.block < 10**12 for r in mixing.permuted(huge, 0).collect())


def test_url_filter(spark):
    rules = registry.URL_RULES
    page = lambda i, url, html="": (i, url, html, "x")
    link = '<link href="{}" REL=canonical>'
    rows = [
        page(1, "http://A.org/x"), page(2, "http://example.org/es/1"), page(3, "http://sub.example.org/en/17?q"), page(4, "http://notexample.org/es/"),
        page(5, "http://x.com/de/1#f"), page(6, "http://alias.net/1", link.format("http://x.com/de/1")), page(7, "http://alias.net/2", '<meta content="0; url=/1" http-equiv="refresh">'),
        page(8, "http://x.com/fr/1", link.format("http://x.com/de/1")), page(9, None), page(10, "mailto:x"), page(11, "http://free.net/"), page(12, "http://alias.net/3", "<!--" + link.format("http://x.com/de/1") + "-->"),
        page(None, "http://alias.net/1"), page(6, "http://alias.net/1#frag", None), page(13, "http://x.org"), page(14, "://h?/p"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = [(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()]
    want = [
        (1, "org/", "allow"), (2, "example.org/es/", "block"), (3, "example.org/en/1", "block"), (4, "org/", "allow"), (5, "com/de/", "block"), (6, None, "block"), (7, None, "block"),
        (8, "com/fr/", "allow"), (9, None, "allow"), (10, None, "allow"), (11, None, "allow"), (12, None, "allow"), (None, None, "block"), (6, None, "block"), (13, None, "allow"), (14, None, "allow"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    many = rules + [("block", f"n{i}.invalid/") for i in range(200)]
    assert sorted(((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages, many).collect()), key=repr) == sorted(want, key=repr)
    first = urlfilter.judge(pages, rules).filter("page_id in (3, 5, 14)").orderBy("page_id").select("host", "path").collect()
    assert [tuple(r) for r in first] == [("sub.example.org", "/en/17"), ("x.com", "/de/1"), ("h", "")]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.2, 3, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, x[3].tolist()) for i in range(30)]
    bad = [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [float("inf")] + [0.0] * 15), (705, [None] + [1.0] * 15), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, score int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    vec = dict(rows)
    hits = total = 0
    for q in [i for i in vec if i % 20 == 0]:
        want = sorted((-float((np.array(vec[i]) * np.array(vec[q])).sum()), i) for i in vec if i != q)[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(s == pytest.approx(float((np.array(vec[i]) * np.array(vec[q])).sum()), abs=1e-12) for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & {i for _, i in want}), total + len(want)
    assert hits / total >= 0.9
    few = ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in few] and len(few) <= 2
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(5000, None, "en", "src0", None), (5001, "123 456", None, None, 7), (5002, "the the and of that", "en", "src1", 19), (5002, "the the and of that", "en", "src1", 19)], docs.schema)
    docs = Scratch(spark).keep(docs.union(odd))
    scratch, texts = Scratch(spark), {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, data))
        assert after.columns == list(corpus_pipeline.COLUMNS)
        ids = {r.doc_id for r in after.collect()}
        if name == "language_id":
            assert ids == set(texts) - {5000, 5001}
        elif name == "exact_dedup":
            least = {}
            for r in docs.collect():
                least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
            assert ids == set(least.values()) and after.count() == len(ids)
        elif name == "simhash_near_dedup":
            assert len(ids) <= docs.count() and ids
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert len(last) == docs.count() and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_deduplication_keeps_different_texts_of_one_id(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10000)}" for _ in range(60)) for _ in range(5)]
    ids = [None, None, None, 7, 7]
    rows = [(i, t, "en", "src0", len(t)) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        assert sorted(r.text for r in stage(spark, docs, "").collect()) == sorted(texts)


def test_chunks_met_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    encoder = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    worked_out, piece = [], encoder.piece
    monkeypatch.setattr(encoder, "piece", lambda data: worked_out.append(data) or piece(data))
    for i in range(400):
        encoder.packed(f" often u{i}x")
    assert worked_out.count(b" often") == 1


def test_labels_side_by_side_are_those_of_each_text():
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], list("<>xyz"), rng.normal(size=(6, 3)).astype(np.float32) * 9, {"Latin": [0, 1, 2]}, penalty=2.0)
    texts = [" ".join("".join(rng.choice(list("xyz"), rng.integers(1, 4))) for _ in range(n)) for n in (5, 0, 40, 1, 17, 40)]
    for text, (found, path) in zip(texts, model.label(texts)):
        v, back = None, []
        for s in model.rows[found]:
            if v is None:
                v = s.copy()
                continue
            v = v - v.max()
            back.append(np.where(v >= -2.0, np.arange(3), v.argmax()))
            v = np.maximum(v, np.float32(-2.0)) + s
        want = [] if v is None else [int(v.argmax())]
        for b in back[::-1]:
            want.append(int(b[want[-1]]))
        assert path.tolist() == want[::-1]


def test_bpe_states(monkeypatch):
    """Behind any text the state has all tokens that the text ends with, longest first, and few steps are remembered."""
    b, text = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "internationalisation été 1999 aaaaaaaaaa".encode()
    monkeypatch.setattr(bpe, "STEPS", len(b.steps) + 2)
    state = 0
    for i in range(1, len(text) + 1):
        state = b.step(state << 8 | text[i - 1])
        assert list(b.ending[state]) == [(n, b.ranks[text[i - n : i]]) for n in range(min(i, b.longest), 0, -1) if text[i - n : i] in b.ranks]
    assert len(b.steps) <= bpe.STEPS
    whole, parts = bpe.Prefixes(b, text), bpe.Prefixes(b)
    for i in range(0, len(text), 3):
        parts.append(text[i : i + 3])
    assert parts.last == whole.last


def test_places_once():
    assert tokenfile.once(np.array([0, 0, 1, 0, 1, 2, 4, 5, 6, 5, 6, 7])).tolist() == [0, 1, 2, 4, 5, 6, 7]
    assert tokenfile.once(np.empty(0, np.int64)).tolist() == []
