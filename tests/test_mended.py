"""Cases that once went wrong."""

import math
import random

from pyspark.sql import functions as F

from basalt.engine import Engine
from basalt.operators import cypher, datalog, documents, governance, joins, tables, timeseries
from basalt.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_continuous_aggregate_open_bucket_and_restart(spark, tmp_path):
    p = lambda r: spark.createDataFrame(r, "series string, ts long, value double")
    agg = timeseries.ContinuousAggregate(spark, str(tmp_path / "c"), 10, "sum")
    assert agg.refresh(p([("a", 1, 1.0)])) is None
    assert rows(agg.query().select("bucket", "value")) == [(0, 1.0)]
    more = [("a", 1, 1.0), ("a", 4, 1.0)]
    agg.refresh(p(more))
    assert rows(agg.query().select("bucket", "value")) == [(0, 2.0)]
    agg.refresh(p([*more, ("a", 12, 5.0)]))
    again = timeseries.ContinuousAggregate(spark, str(tmp_path / "c"), 10, "sum")
    assert again.watermark == 10 and again.refresh(p([*more, ("a", 12, 5.0), ("a", 20, 1.0)])) == 20
    assert rows(again.query().select("bucket", "value")) == [(0, 2.0), (10, 5.0)]


def test_datalog_null_facts_end(spark):
    d = datalog.Program(spark)
    d.facts["edge"] = spark.createDataFrame([("1", "2"), ("2", "1"), ("2", None)], "c0 string, c1 string")
    d.rule("reach(X, Y) :- edge(X, Y).")
    d.rule("reach(X, Z) :- reach(X, Y), edge(Y, Z).")
    d.evaluate()
    assert rows(d.facts["reach"]) == sorted([("1", "2"), ("2", "1"), ("1", "1"), ("2", "2"), ("1", None), ("2", None)], key=repr)


def test_cypher_open_ranges(spark):
    nodes = spark.createDataFrame([(i, ["N"], {"k": str(i)}) for i in range(1, 15)], "id long, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([(i, i + 1, "E", {}) for i in range(1, 14)], "src long, dst long, type string, props map<string,string>")
    g = cypher.Graph(nodes, edges)
    ends = lambda r: rows(g.run(f"MATCH (a:N {{k: '1'}})-[:E{r}]->(b) RETURN b.k").select(F.col("`b.k`").cast("int")))
    assert ends("*2..") == [(i,) for i in (10, 11, 3, 4, 5, 6, 7, 8, 9)]
    assert ends("*") == [(i,) for i in (10, 11, 2, 3, 4, 5, 6, 7, 8, 9)]
    assert ends("*2") == [(3,)] and ends("*..2") == [(2,), (3,)] and ends("*2..3") == [(3,), (4,)]


def test_radius_join_around_the_globe(spark):
    rng = random.Random(3)
    points = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(300)]
    points += [(300, 0.0, 179.9), (301, 0.0, -179.9), (302, 89.9, 10.0), (303, 89.9, -170.0), (304, 90.0, 0.0), (305, -90.0, 5.0), (306, -85.0, 180.0), (307, -85.0, -180.0), (308, 84.0, 30.0), (309, 84.0, 40.0)]
    a = spark.createDataFrame(points, "i long, la double, lo double")
    b = a.select(F.col("i").alias("j"), F.col("la").alias("lb"), F.col("lo").alias("lp"))

    def metres(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * joins.EARTH * math.asin(math.sqrt(min(1.0, x)))

    for radius in (50_000.0, 900_000.0, 9_000_000.0):
        got = [(r.i, r.j) for r in joins.radius_join(a, b, radius, "la", "lo", "lb", "lp").collect()]
        want = {(p[0], q[0]) for p in points for q in points if metres(p, q) <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_stream_log_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    assert streams.StreamLog(spark, path).add([(5, {"a": "1"})]) == ["5-0"]
    again = streams.StreamLog(spark, path)
    assert again.add([(5, {"a": "2"}), (4, {"a": "3"}), (6, {})]) == ["5-1", "5-2", "6-0"]


def test_find_by_several_typed_keys(spark):
    docs = spark.createDataFrame([(d,) for d in ['{"g": "x", "n": 10}', '{"g": "x", "n": 9}', '{"g": "y", "n": 1}', '{"g": "x", "n": "9"}', '{"g": "y"}', "no json"]], "doc string")
    got = documents.find(docs, "doc", order=[("g", True), ("n", False)], fields=["g", "n"]).collect()
    assert [tuple(r) for r in got] == [("y", None), ("y", "1"), ("x", "9"), ("x", "10"), ("x", "9"), (None, None)]
    assert documents.find(docs, "doc", {"n": 9}).count() == 1 and documents.find(docs, "doc", {"n": "9"}).count() == 1
    assert documents.find(docs, "doc", {"g": "x"}, [("n", False)], ["n"], limit=1).first()[0] == "9"


def test_distinct_on_keeps_the_order(spark):
    spark.range(7).selectExpr("id AS k", "explode(array(2, 1)) AS v").createOrReplaceTempView("dist_t")
    e = Engine(spark)
    assert [tuple(r) for r in e.sql("SELECT DISTINCT ON (k) k, v FROM dist_t ORDER BY k DESC, v LIMIT 3").collect()] == [(6, 1), (5, 1), (4, 1)]
    assert [r[0] for r in e.sql("SELECT DISTINCT ON (k) v FROM dist_t ORDER BY k, abs(v) DESC NULLS LAST LIMIT 2").collect()] == [2, 2]


def test_containment_in_sql(spark):
    spark.createDataFrame([(1, '{"a": {"b": 1}, "t": [1, 2]}'), (2, '{"a": {"b": "1"}}'), (3, None)], "i int, d string").createOrReplaceTempView("cont_t")
    e = Engine(spark)
    ids = lambda q: [r[0] for r in e.sql(f"SELECT i FROM cont_t WHERE {q} ORDER BY i").collect()]
    assert ids("""d @> '{"a": {"b": 1}}'""") == [1] and ids("""d::jsonb @> '{"t": [2]}'::jsonb""") == [1]
    assert ids("""'{"a": {"b": "1"}}' <@ d AND i > 0""") == [2] and ids("""NOT d @> '{}'""") == []
    assert ids("""d -> 'a' @> '{"b": 1}'""") == [1]


def test_phone_numbers_have_fifteen_digits_at_most(spark):
    kinds = lambda v: spark.range(1).select(governance.pii_categories(F.lit(v))).first()[0]
    assert "Phone" in kinds("+1 (555) 123-4567") and "Phone" in kinds("1" * 15) and "Phone" not in kinds("1" * 20) and "Phone" not in kinds("123456789")


def test_change_feed_batch_run_again(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    streams.change_feed(stream(), ["k"], str(tmp_path / "out"), str(tmp_path / "one"))
    streams.change_feed(stream(), ["k"], str(tmp_path / "out"), str(tmp_path / "two"))  # the same batch once more
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k", "batch")) == [(1, 0), (2, 0)]


def test_merge_with_null_keys(spark):
    t = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "k long, v string")
    s = spark.createDataFrame([(None, "x"), (2, "y")], "k long, v string")
    assert rows(tables.merge(t, s, ["k"])) == rows(spark.createDataFrame([(None, "x"), (1, "b"), (2, "y")], "k long, v string"))


def test_radius_join_deals_a_cell_to_parts(spark, monkeypatch):
    """All rows near a pole are in one cell, which is no single task's."""
    monkeypatch.setattr(joins, "ROWS", 20)
    monkeypatch.setattr(joins, "MEASURED", 2000)
    at = spark.range(200).selectExpr("id AS i", "90 - id * 37 % 200 / 40.0D AS la", "id * 91 % 360 - 180.0D AS lo")
    b = at.select(F.col("i").alias("j"), F.col("la").alias("lb"), F.col("lo").alias("lp"))
    got = joins.radius_join(at, b, 500_000.0, "la", "lo", "lb", "lp")
    want = at.crossJoin(b).withColumn("metres", joins.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))).filter("metres <= 500000")
    assert rows(got) == rows(want) and got.columns == want.columns
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 4 and max(tasks) < sum(tasks) / 3


def test_radius_join_keeps_pairs_at_the_radius(spark):
    """Points apart by the radius itself, by haversine's own rounding."""
    at = spark.range(2000).selectExpr("id AS i", "id % 50 - 25.0D AS la", "id * 7 % 40 * 1.0D AS lo")
    b = at.select(F.col("i").alias("j"), F.col("la").alias("lb"), F.col("lo").alias("lp")).filter("j < 300")
    both = at.crossJoin(b).withColumn("metres", joins.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")))
    for radius in [both.filter(f"i = {i} AND j = 3").first()["metres"] for i in (4, 57)]:
        assert rows(joins.radius_join(at, b, radius, "la", "lo", "lb", "lp").select("i", "j")) == rows(both.filter(F.col("metres") <= radius).select("i", "j"))
