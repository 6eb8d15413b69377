"""Search without an index."""

from pyspark.sql import functions as F

from basalt.functions import text
from basalt.operators import search


def test_stemmed_scan_equals_the_index(spark):
    """Words are stemmed only where they can have a wanted stem."""
    texts = ["Flies fly, the flying fly", "running runs runner ran", "classes class classy", "nation nations nativity nat", None, "", "it's the is", "ies es s blendings blended"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for language, rules in text.SUFFIXES.items():
        words = "flies classes ies s tion".split() + [f"{x}{s}" for suffixes, _, _ in rules for s in suffixes.split()[:2] for x in ("abcd", "ab")]
        w = spark.createDataFrame([(x,) for x in words], "w string")
        stems = sorted({r[0] for r in w.select(text.stem(F.col("w"), language)).collect()})
        wrong = w.select([F.count_if(text.stems_to(F.col("w"), s, language) != (text.stem(F.col("w"), language) == s)).alias(str(i)) for i, s in enumerate(stems)]).first()
        assert not any(wrong)
    for q in ("flies", "class nations", "running blending"):
        wanted = search.terms(q, spark)
        scan = search.bm25_scan(docs, "id", "t", wanted, tokens=text.kept_words, match=text.stems_to)
        assert [(r.doc, round(r.score, 12)) for r in scan.collect()] == [(r.doc, round(r.score, 12)) for r in search.bm25(search.build(docs, "id", "t"), wanted).collect()]


def test_term_counts_need_no_shuffle_of_tokens(spark):
    texts = [(1, "a b a c"), (2, "b b"), (3, None), (4, ""), (5, "c")]
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    counts = lambda r: search.term_counts(spark.createDataFrame(r, "id int, t string"), "id", "t", split)
    assert sorted(map(tuple, counts(texts).collect())) == [("a", 1, 2), ("b", 2, 3), ("c", 2, 2)]
    assert counts(texts)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted(map(tuple, counts([*texts, (1, "a d")]).collect())) == [("a", 1, 3), ("b", 2, 3), ("c", 2, 2), ("d", 1, 1)]
