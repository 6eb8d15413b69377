"""Connected components by randomised contraction, all rounds distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge between two different nodes; component is the
    smallest node of its component. Null ends and self loops are ignored, repeated edges count once,
    no edges give no rows.

    Each round, every node moves to the node of least random rank in its closed neighbourhood, and
    the graph is contracted to the nodes moved to. A fresh rank each round makes nodes fall by a
    constant factor whatever the shape, so rounds are logarithmic, and each round's tables are
    smaller than the last. Moves are then composed from the last round back."""
    kind = edges.schema[src].dataType
    e = edges.select(F.col(src).alias("u"), F.col(dst).cast(kind).alias("v")).filter("u <> v")
    e = scratch.keep(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    moves = []
    while not e.isEmpty():
        rank = lambda c, r=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("r"), F.col(c).alias("x"))
        near = e.groupBy("u").agg(F.min(rank("v")).alias("m"))
        moves.append(scratch.keep(near.select(F.col("u").alias("node"), F.least("m", rank("u"))["x"].alias("to"))))
        p = moves[-1]
        half = e.join(p, e.u == p.node).select(F.col("to").alias("u"), "v")
        q = p.withColumnRenamed("to", "w")
        after = half.join(q, half.v == q.node).select("u", F.col("w").alias("v")).filter("u <> v").distinct()
        after = scratch.keep(after)
        scratch.drop(e)
        e = after
    if not moves:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = moves.pop()
    while moves:
        up, down = label.select(F.col("node").alias("to"), F.col("to").alias("root")), moves.pop()
        label = down.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    label = scratch.keep(label)
    least = label.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    return label.join(least, "to").select("node", "component")
