"""Property graphs: vertices (id, labels array, props map) and edges (src, dst, type, …).

Iterative algorithms write each round's frame, so that plans don't grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.scratch import keep


def neighbors(edges: DataFrame, node: object, direction: str = "out", kind: str | None = None) -> DataFrame:
    e = edges.filter(F.col("type") == kind) if kind else edges
    out = e.filter(F.col("src") == node).select(F.col("dst").alias("id"))
    into = e.filter(F.col("dst") == node).select(F.col("src").alias("id"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def bfs(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, id, hops) for every node that each source (id) reaches along edges, itself included.
    A round joins the newest nodes only; nodes seen before are dropped by an anti join."""
    seen = keep(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")).distinct())
    front, hops = seen, 0
    e = edges.select("src", "dst").distinct()
    while max_hops is None or hops < max_hops:
        hops += 1
        step = front.join(e, front.id == e.src).select("source", F.col("dst").alias("id")).distinct()
        front = keep(step.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: object, end: object) -> list | None:
    """Nodes on a path of fewest edges, of these the first in order; None without one. Each node keeps
    one predecessor, and the path alone comes to the driver."""
    e = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    seen = front = keep(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(kind).alias("via")))
    levels = [front]
    while start != end and front.filter(F.col("id") == end).isEmpty():
        step = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        front = keep(step.join(seen, "id", "left_anti"))
        if front.isEmpty():
            return None
        seen = seen.unionByName(front)
        levels.append(front)
    path = [end]
    for level in reversed(levels[1:]):
        path.append(level.filter(F.col("id") == path[-1]).first()["via"])
    return path[::-1]


def dijkstra(edges: DataFrame, start: object, weight: str = "weight") -> DataFrame:
    """(id, distance) of least total weight from `start`, for weights of 0 or more. Each round relaxes the
    edges of nodes that came nearer in the last one; it ends when none did."""
    if edges.filter(F.col(weight) < 0).limit(1).count():
        raise ValueError("negative weight")
    kind = edges.schema["src"].dataType
    best = front = keep(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0.0).alias("distance")))
    e = edges.groupBy("src", "dst").agg(F.min(weight).cast("double").alias("w"))
    while True:
        step = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("to"))
        front = keep(step.join(best, "id", "left").filter(F.col("distance").isNull() | (F.col("to") < F.col("distance"))).select("id", F.col("to").alias("distance")))
        if front.isEmpty():
            return best
        best = keep(best.union(front).groupBy("id").agg(F.min("distance").alias("distance")))


def variable_paths(edges: DataFrame, sources: DataFrame, least: int, most: int) -> DataFrame:
    """(source, id, path) for all outgoing paths of least..most edges that repeat no node."""
    paths = sources.select(F.col("id").alias("source"), "id", F.array("id").alias("path"))
    out = paths if least == 0 else None
    for n in range(1, most + 1):
        e = edges.select("src", "dst")
        paths = paths.join(e, paths.id == e.src).filter(~F.array_contains("path", F.col("dst")))
        paths = keep(paths.select("source", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        if out is not None and paths.isEmpty():
            break
        if n >= least:
            out = paths if out is None else out.unionByName(paths)
    return out


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component), component being the smallest id. Nodes point to smaller ones (large-star and
    small-star steps) until all point to a root; both steps keep the number of edges in bounds."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    e = keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        small = keep(small.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct())
        if small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty():
            break
        e = small
    labels = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = labels.union(roots).groupBy("id").agg(F.min("component").alias("component"))
    if vertices is not None:
        out = vertices.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out


def pagerank(edges: DataFrame, vertices: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; what nodes without edges hold is spread over all."""
    nodes = keep(vertices.select("id").distinct())
    n = nodes.count()
    e = edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count("*").alias("n_out"))
    e = keep(e.join(out, "src"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = e.join(rank, e.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        loose = rank.join(out, rank.id == out.src, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        rank = nodes.join(given, "id", "left").join(F.broadcast(loose))
        rank = keep(rank.select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank")))
    return rank


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): all nodes take the commonest label among neighbours at once, ties to the smallest."""
    e = edges.select("src", "dst")
    both = keep(e.union(e.select("dst", "src")))
    label = keep(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = both.join(label, both.dst == label.id).groupBy("src", "label").agg(F.count("*").alias("n"))
        new = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        new = keep(new)
        if new.exceptAll(label).isEmpty():
            return new
        label = new
    return label


def louvain_phase(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by greedy gain of modularity, undirected, edges counted once. In even rounds nodes may only
    move to a smaller community, in odd ones to a greater, so that no two swap for ever."""
    e = edges.select("src", "dst").filter("src <> dst")
    e = keep(e.union(e.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").alias("w")))
    degree = keep(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1
    at = keep(degree.select("id", "k", F.col("id").alias("community")))
    for r in range(rounds):
        size = at.groupBy("community").agg(F.sum("k").alias("size"))
        links = e.join(at.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("links"))
        own = at.select("id", "k", F.col("community").alias("own"))
        stay = own.select("id", F.col("own").alias("community"), F.lit(0).cast("long").alias("links"))
        options = links.union(stay).groupBy("id", "community").agg(F.sum("links").alias("links")).join(own, "id").join(size, "community")
        others = F.col("size") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.col("links") - others * F.col("k") / float(total)
        way = F.col("community") <= F.col("own") if r % 2 == 0 else F.col("community") >= F.col("own")
        best = options.filter(way).groupBy("id").agg(F.max_by("community", F.struct(gain, F.col("community") == F.col("own"), -F.col("community"))).alias("new"))
        new = keep(at.join(best, "id").select("id", "k", F.col("new").alias("community")))
        if r % 2 and new.exceptAll(at).isEmpty():
            break
        at = new
    return at.select("id", "community")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def match(vertices: DataFrame, edges: DataFrame, from_label: str | None, kind: str | None, to_label: str | None) -> DataFrame:
    """(src, dst) of edges of a type between nodes with labels; null takes any."""
    e = edges.filter(F.col("type") == kind) if kind else edges
    for end, label in (("src", from_label), ("dst", to_label)):
        if label:
            ok = vertices.filter(F.array_contains("labels", label)).select(F.col("id").alias(end))
            e = e.join(ok, end, "left_semi")
    return e.select("src", "dst")


def dfs(edges: DataFrame, start: object, limit: int = 100_000) -> list:
    """Nodes in depth-first preorder, smaller ones first. The order is serial, so what `start` reaches
    comes to the driver, after its size is checked."""
    reached = bfs(edges, edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("id")))
    if reached.limit(limit + 1).count() > limit:
        raise ValueError(f"over {limit} nodes reached")
    inner = edges.join(reached.select(F.col("id").alias("src")), "src", "left_semi")
    w = Window.partitionBy("src").orderBy("dst")
    pairs = inner.select("src", "dst").distinct().withColumn("n", F.row_number().over(w)).collect()
    after: dict = {}
    for r in sorted(pairs, key=lambda r: r["n"]):
        after.setdefault(r["src"], []).append(r["dst"])
    seen, out, stack = set(), [], [start]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            out.append(x)
            stack += reversed(after.get(x, []))
    return out
