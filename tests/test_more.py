"""List commands, bitmaps, geo sets, statements with RETURNING, optional matches."""

from pyspark.sql import functions as F

from basalt.operators import collections as kv
from basalt.operators import cypher, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_list_commands(spark):
    log = [(1, "a", "rpush", "x"), (2, "a", "lpush", "y"), (3, "a", "rpush", "z"), (4, "a", "lpop", None), (5, "a", "rpop", None), (1, "b", "lpop", None), (2, "b", "rpush", "q"), (1, "c", "rpop", None)]
    got = kv.list_commands(spark.createDataFrame(log, "seq int, key string, command string, value string"))
    assert rows(got) == [("a", ["x"]), ("b", ["q"]), ("c", [])]
    assert kv.list_commands(spark.createDataFrame([], "seq int, key string, command string, value string")).count() == 0


def test_bitmaps(spark):
    log = [(1, "a", 0, 1), (2, "a", 1, 1), (3, "a", 5, 1), (4, "a", 5, 0), (1, "b", 1, 1), (2, "b", 7, 1)]
    state = kv.bitmaps(spark.createDataFrame(log, "seq int, key string, offset long, bit int"))
    assert rows(state) == [("a", 0), ("a", 1), ("b", 1), ("b", 7)]
    for how, want in (("and", [(1,)]), ("or", [(0,), (1,), (7,)]), ("xor", [(0,), (7,)])):
        assert rows(kv.bit_operation(state, ["a", "b"], how)) == want
    assert rows(kv.bit_position(state, 1)) == [("a", 0), ("b", 1)] and rows(kv.bit_position(state, 0)) == [("a", 2), ("b", 0)]


def test_geo_sets(spark):
    log = [(1, "g", "p", 13.361389, 38.115556), (2, "g", "c", 0.0, 0.0), (3, "g", "c", 15.087269, 37.502669)]
    state = kv.geo_sets(spark.createDataFrame(log, "seq int, key string, member string, lon double, lat double"))
    near = {r.member: r.distance for r in kv.geo_radius_by_member(state, "g", "p", 200_000.0).collect()}
    assert near["p"] == 0 and abs(near["c"] - 166_274) < 200
    assert [r.member for r in kv.geo_radius(state, "g", 15.0, 37.0, 100_000.0).collect()] == ["c"]


def test_returning_and_truncate(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    assert rows(tables.update_returning(t, F.col("v") > 5, v=F.col("v") + 1)) == [(3, 8)]
    assert rows(tables.delete_returning(t, F.col("v") > 4)) == [(1, 5), (3, 7)]
    new = spark.createDataFrame([(3, 1), (4, 2)], "k int, v int")
    assert rows(tables.upsert_returning(t, new, ["k"])) == [(3, 1), (4, 2)] and rows(tables.upsert_returning(t, new, ["k"], False)) == [(4, 2)]
    assert tables.truncate(t).columns == ["k", "v"] and tables.truncate(t).count() == 0


def test_optional_match(spark):
    nodes = spark.createDataFrame([(i, ["N"], {"k": str(i)}) for i in range(1, 5)], "id long, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([(1, 2, "E", {}), (1, 3, "E", {}), (2, 4, "F", {})], "src long, dst long, type string, props map<string,string>")
    g = cypher.Graph(nodes, edges)
    assert rows(g.run("MATCH (a:N) OPTIONAL MATCH (a)-[:E]->(b) RETURN a, b")) == [(1, 2), (1, 3), (2, None), (3, None), (4, None)]
    assert rows(g.run("MATCH (a:N) OPTIONAL MATCH (a)-[:E]->(b) WHERE b.k > 2 RETURN a, b.k AS k")) == [(1, "3"), (2, None), (3, None), (4, None)]
    assert rows(g.run("OPTIONAL MATCH (a:Missing) RETURN a")) == [(None,)]
    assert rows(g.run("OPTIONAL MATCH (a:N {k: '4'}) RETURN a")) == [(4,)]
