"""Operators on small frames: edge cases that the tables lack."""

import pytest
from pyspark.sql import functions as F

from basalt.functions import text as analysis
from basalt.operators import collections as kv
from basalt.operators import cypher, datalog, documents, governance, graph, joins, search, tables, timeseries, vectors
from basalt.sources import files
from basalt.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_as_of_join_keeps_or_drops_unmatched(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 5, "y"), (2, 3, "z")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 6, 60), (1, 9, 90), (1, 11, 110)], "k int, s int, w int")
    assert rows(joins.as_of_join(a, b, ["k"], "t", "s", ["w"])) == [(1, 10, "x", 90)]
    assert rows(joins.as_of_join(a, b, ["k"], "t", "s", ["w"], inner=False)) == [(1, 10, "x", 90), (1, 5, "y", None), (2, 3, "z", None)]


def test_range_join_finds_each_pair_once(spark):
    p = spark.createDataFrame([(float(x),) for x in range(-3, 12)], "x double")
    r = spark.createDataFrame([(0.0, 7.5), (3.0, 3.0), (-2.0, -1.0)], "lo double, hi double")
    want = sorted((x, lo, hi) for x in map(float, range(-3, 12)) for lo, hi in [(0.0, 7.5), (3.0, 3.0), (-2.0, -1.0)] if lo <= x < hi)
    assert sorted(map(tuple, joins.range_join(p, r, "x", "lo", "hi", 2.0).select("x", "lo", "hi").collect())) == want


def test_stems_follow_the_rules(spark):
    cases = {"running": "run", "flies": "fly", "nation": "nat", "kindness": "kind", "classes": "class", "quickly": "quick", "boss": "boss", "cats": "cat", "the": "the"}
    got = spark.createDataFrame(list(cases.items()), "w string, s string").select("w", analysis.stem(F.col("w")).alias("g"), "s").collect()
    assert {r.w: r.g for r in got} == cases
    de = spark.range(1).select(analysis.stem(F.lit("zeitungen"), "german"), analysis.stem(F.lit("chansons"), "french"), analysis.stem(F.lit("canción"), "spanish")).first()
    assert tuple(de) == ("zeit", "chanson", "canc")


def test_analyzers(spark):
    a = analysis.analyzer(analysis.html_strip, analysis.ascii_folding, analysis.whitespace_tokens, analysis.lowercase, analysis.length_filter(2, 6), analysis.synonym_filter({"cafe": ["bar"]}))
    assert spark.range(1).select(a(F.lit("<b>Café</b> a résumé extraordinary"))).first()[0] == ["cafe", "bar", "resume"]
    n = spark.range(1).select(analysis.ngram_tokens(2, 3)(F.lit("abcd")), analysis.ngram_tokens(1, 2)(F.lit("")), analysis.edge_ngram_tokens(1, 3)(F.lit("ab"))).first()
    assert tuple(n) == (["ab", "abc", "bc", "bcd", "cd"], [], ["a", "ab"])


def test_highlight_joins_stretches(spark):
    text = F.lit("one two cat four five six seven eight cat ten")
    got = spark.range(1).select(analysis.highlight(text, F.lit("cats"), 1), analysis.highlight(text, F.lit("zebra"), 1), analysis.ts_headline(text, F.lit("cat"))).first()
    assert got[0] == "two cat four ... eight cat ten"
    assert got[1].startswith("one two") and got[2].count("<b>cat</b>") == 2


def test_bm25_prefers_rare_terms_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple pear"), (3, "apple fig"), (4, None)], "id int, t string")
    ix = search.build(docs, "id", "t")
    assert [r.doc for r in search.bm25(ix, search.terms("apple fig", spark)).collect()] == [3, 1, 2]
    assert [r.doc for r in search.bm25(ix, search.terms("pear apple", spark), require_all=True).collect()] == [1, 2]
    assert [r.doc for r in search.fuzzy(ix, ["figs"], 1).collect()] == [3]


def test_continuous_aggregate_ignores_late_points_below_the_watermark(spark, tmp_path):
    p = lambda x: spark.createDataFrame(x, "series string, ts long, value double")
    agg = timeseries.ContinuousAggregate(spark, str(tmp_path / "c"), 10, "sum")
    first = [("a", 1, 1.0), ("a", 12, 2.0), ("a", 25, 4.0)]
    assert agg.refresh(p(first)) == 20
    assert agg.refresh(p([*first, ("a", 3, 100.0), ("a", 31, 8.0)])) == 30
    assert rows(agg.query().select("bucket", "value")) == [(0, 1.0), (10, 2.0), (20, 4.0)]


def test_graph_algorithms(spark):
    e = spark.createDataFrame([(1, 2, "a", 1.0), (2, 3, "a", 1.0), (1, 3, "b", 5.0), (3, 1, "a", 1.0), (7, 8, "a", 2.0)], "src long, dst long, type string, weight double")
    assert graph.shortest_path(e, 1, 3) == [1, 3] and graph.shortest_path(e, 1, 8) is None and graph.shortest_path(e, 1, 1) == [1]
    assert rows(graph.dijkstra(e, 1)) == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert rows(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert graph.dfs(e, 1) == [1, 2, 3]
    ranks = dict(rows(graph.pagerank(e, spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8)], "id long"), 30)))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[8] > ranks[7]
    two = spark.createDataFrame([(a, b) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5)], "src long, dst long")
    found = dict(rows(graph.louvain_phase(two)))
    assert len({found[i] for i in (1, 2, 3)}) == 1 and found[1] != found[8]


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.component for r in graph.components(e).collect()} == {0}


def people(spark):
    v = spark.createDataFrame([(1, ["Person"], {"name": "Ann", "age": "30"}), (2, ["Person"], {"name": "Bob", "age": "40"}), (3, ["City"], {"name": "Rome"})], "id long, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(1, 2, "KNOWS", {"since": "2020"}), (2, 3, "LIVES", {})], "src long, dst long, type string, props map<string,string>")
    return cypher.Graph(v, e)


def test_cypher(spark):
    g = people(spark)
    assert rows(g.run("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b")) == [("Ann", "Bob")]
    assert rows(g.run("MATCH (a:Person)-[]-(b) WHERE a.age >= 40 RETURN b")) == [(1,), (3,)]
    assert rows(g.run("MATCH (a)-[*1..2]->(b:City) RETURN a.name")) == [("Ann",), ("Bob",)]
    assert rows(g.run("MATCH (p:Person) RETURN COUNT(*)")) == [(2,)]
    g2 = g.run("CREATE (x:Person {id: 9, name: 'Cy'})-[:KNOWS]->(y:Person {id: 10, name: 'Di'})")
    assert rows(g2.run("MATCH (a {name: 'Cy'})-[:KNOWS]->(b) RETURN b.name")) == [("Di",)]
    assert rows(g2.run("MATCH (a {name: 'Bob'}) DELETE a").run("MATCH (a)-[]->(b) RETURN a")) == [(9,)]


def test_datalog(spark):
    p = datalog.Program(spark)
    for f in ("edge(a, b)", "edge(b, c)", "edge(c, a)", "node(a)", "node(b)", "node(c)", "node(d)"):
        p.assert_fact(f)
    p.rule("path(X, Y) :- edge(X, Y)")
    p.rule("path(X, Y) :- path(X, Z), path(Z, Y)")
    p.rule("lonely(X) :- node(X), not path(X, _)")
    p.rule("reach(X, count(Y)) :- path(X, Y)")
    p.evaluate()
    assert p.query("path(X, Y)").count() == 9 and rows(p.query("lonely(X)")) == [("d",)]
    assert rows(p.query("reach(a, N)")) == [("a", "3")] and p.query("path(X, X)").count() == 3
    q = datalog.Program(spark)
    q.rule("a(X) :- b(X), not a(X)")
    with pytest.raises(ValueError):
        q.evaluate()


def test_documents(spark):
    d = spark.createDataFrame([(1, '{"a":{"b":"x"},"n":[1,2],"z":null}'), (2, '{"a":{"b":5}}'), (3, None)], "id int, j string")
    j = F.col("j")
    assert rows(d.filter(documents.contains(j, {"a": {"b": "x"}})).select("id")) == [(1,)]
    assert rows(d.filter(documents.contains(j, {"n": [2]})).select("id")) == [(1,)]
    assert rows(d.filter(documents.contains(j, {"a": {"b": "5"}})).select("id")) == []
    assert d.select(documents.set_path(j, ["a", "c"], 7), documents.strip_nulls(j)).first()[0] == '{"a":{"b":"x","c":7},"n":[1,2],"z":null}'
    assert d.select(documents.strip_nulls(j)).first()[0] == '{"a":{"b":"x"},"n":[1,2]}'


def test_collections(spark):
    log = spark.createDataFrame([(1, "k", "left", "a"), (2, "k", "right", "b"), (3, "k", "left", "c")], "seq int, key string, side string, value string")
    assert kv.lists(log).first()["items"] == ["c", "a", "b"]
    got = kv.lists(log).select(kv.list_range(F.col("items"), -2, -1), kv.list_range(F.col("items"), 5, 9)).first()
    assert tuple(got) == (["a", "b"], [])
    m = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3)], "key string, member int")
    assert [rows(kv.set_operation(m, ["x", "y"], how)) for how in ("inter", "union", "diff")] == [[(2,)], [(1,), (2,), (3,)], [(1,)]]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string")
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d"), (None, "m")]
    assert rows(tables.upsert(old, new, ["k"], update=False)) == [(1, "a"), (2, "b"), (3, "d"), (None, "n")]
    assert sorted((r.k or 0, r.change) for r in tables.diff(old, new, ["k"]).collect()) == [(0, "modified"), (1, "deleted"), (2, "modified"), (3, "added")]


def test_governance(spark):
    v = spark.createDataFrame([("a@b.org",), ("123-45-6789",), ("4111 1111 1111 1111",), ("10.0.0.1",), ("hello",), (None,)], "v string")
    found = [r[0] for r in v.select(governance.pii_categories(F.col("v"))).collect()]
    assert [("Email" in f, "Ssn" in f, "CreditCard" in f, "IpAddress" in f) for f in found[:4]] == [tuple(i == k for k in range(4)) for i in range(4)]
    assert found[4:] == [[], []]
    assert governance.deletion_plan({"orders": ["users"], "items": ["orders"], "logs": []}, "users") == ["items", "orders", "users"]
    assert governance.name_hints("user_email") == {"Email": 0.8} and governance.name_hints("description") == {}
    noisy = [governance.private(v, "count", None, 1.0, seed=s).first()[0] for s in range(20)]
    assert abs(sum(noisy) / 20 - 6) < 3 and len(set(noisy)) > 1


def test_copy_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "id int, t string")
    for fmt in ("csv", "text"):
        files.copy_to(d, str(tmp_path / fmt), fmt)
        assert rows(files.copy_from(spark, str(tmp_path / fmt), "id int, t string", fmt)) == rows(d)


def test_materialized_view(spark, tmp_path, data):
    spark.read.parquet(f"{data}/nation.parquet").createOrReplaceTempView("mv_nation")
    mv = files.MaterializedView(spark, str(tmp_path / "mv"), "SELECT n_regionkey, count(*) AS n FROM mv_nation GROUP BY n_regionkey")
    with pytest.raises(ValueError):
        mv.read()
    mv.refresh()
    mv.refresh()
    assert mv.read().count() == 5


def test_stream_log_and_group(spark, tmp_path):
    log = streams.StreamLog(spark, str(tmp_path / "log"))
    assert log.add([(5, {"a": "1"}), (5, {"a": "2"}), (9, {"a": "3"})]) == ["5-0", "5-1", "9-0"]
    assert [r.seq for r in log.range((5, 1), (9, 0)).collect()] == [1, 0]
    assert [r.ms for r in log.after((5, 1)).collect()] == [9]
    g = streams.ConsumerGroup(log, str(tmp_path / "group"))
    assert g.read("x", 2) == [(5, 0), (5, 1)] and g.read("y", 5) == [(9, 0)] and g.read("y", 5) == []
    g.ack([(5, 0)])
    assert rows(g.pending().select("ms", "seq")) == [(5, 1), (9, 0)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<float>")
    assert [r.id for r in vectors.knn(v, [1.0, 0.2], 2).collect()] == [1, 3]
    assert spark.range(1).select(vectors.chunks(F.lit("abcdefgh"), 4, 1)).first()[0] == ["abcd", "defg", "gh"]


def test_models_and_sequences(spark):
    from basalt.functions import udf
    from basalt.operators import ml
    from basalt.streaming import queues

    d = spark.createDataFrame([(1, "cat cat dog"), (2, "dog")], "id int, t string")
    got = {(r.doc, r.term): r.weight for r in ml.tf_idf(d, "id", "t").collect()}
    assert got[(1, "cat")] == pytest.approx(2 / 3 * 0.6931471805599453) and got[(2, "dog")] == 0
    x = spark.createDataFrame([(1.0, 0.0), (0.0, 3.0)], "a double, b double")
    m = {"u": ([2.0, 0.0], 0.0), "v": ([0.0, 1.0], 0.5)}
    assert [r[0] for r in x.select(ml.classify(["a", "b"], m)).collect()] == ["u", "v"]
    p = x.select(*ml.softmax(["a", "b"], m).values()).first()
    assert sum(p) == pytest.approx(1) and p[0] == pytest.approx(0.8175744761936437)
    n = ml.next_values(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), ["k"], 10, 5, 7)
    assert rows(n) == [(k, 10 + 5 * k) for k in range(1000)] or sorted(map(tuple, n.collect())) == [(k, 10 + 5 * k) for k in range(1000)]
    udf.install(spark)
    assert rows(spark.sql("SELECT n FROM generate_series_rows(5, 1, -2)")) == [(1,), (3,), (5,)]
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    assert rows(v.groupBy("k").agg(udf.aggregate(lambda s: float(s.max() - s.min()), "double")("v").alias("r"))) == [("a", 2.0), ("b", 0.0)]
    jobs = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "job int, priority int")
    tries = spark.createDataFrame([(1, True), (3, False), (3, False)], "job int, ok boolean")
    assert [r.job for r in queues.runnable(jobs, tries, 2).collect()] == [2] and rows(queues.dead_letters(jobs, tries, 2)) == [(3, 1)]


def test_channels(spark, tmp_path):
    from basalt.streaming import queues

    c, seen = queues.Channels(spark, str(tmp_path / "c")), []
    c.publish("a", "1", "2")
    c.publish("b", "3")
    for _ in range(2):
        c.subscribe("a", str(tmp_path / "check"), lambda df, n: seen.extend(r.payload for r in df.collect())).awaitTermination()
        c.publish("a", "4")
    assert sorted(seen) == ["1", "2", "4"] and c.channels().count() == 2
