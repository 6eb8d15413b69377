"""Mixing sources to target weights (operator 4), in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import Scratch

#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
FEW = 10_000
#: Shards whose slots are numbered together.
SHARDS = 1024
#: Turns of a walk that leaves the indices of a source, see permuted().
TURNS = 24


@dataclass
class Mix:
    """sources: per source its size, target, number of blocks. segments: which words of which row are in
    which block. slots: for each place in each output shard its source and block. rows: per input row
    the words taken."""

    sources: DataFrame
    segments: DataFrame
    slots: DataFrame
    rows: DataFrame


def number(*parts) -> F.Column:  # noqa: ANN002
    """A pseudorandom integer of 52 bits that depends on `parts` only, nulls left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def uniform(*parts) -> F.Column:  # noqa: ANN002
    """A pseudorandom number from 0 to 1 that depends on `parts` only."""
    return number(*parts) / float(1 << 52)


def permuted(slots: DataFrame, seed: int) -> DataFrame:
    """Adds block: index j mod n_blocks of a source, sent through a permutation keyed by the seed, the
    source and the pass. Indices are pairs (l, r) of a rectangle of a x b >= n_blocks cells, about square;
    l and r are moved in turn by a pseudorandom number that depends on the other (a Feistel network of
    four half rounds), and what lands in the rectangle's rest, less than one row of it, is sent on until it
    doesn't. Up to 500 blocks that takes TURNS turns at most; beyond, more have a chance below 1e-30."""
    n, a, b = F.col("n_blocks"), F.col("a"), F.col("b")
    out = slots.withColumn("a", F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    out = out.withColumn("b", F.expr("(n_blocks + a - 1) div a"))
    out = out.withColumn("turn", F.expr("j div n_blocks")).withColumn("x", F.col("j") % n)
    out = out.withColumn("l", F.expr("x div b")).withColumn("r", F.col("x") % b)
    move = lambda i, other: number(F.lit(seed), F.col("key"), F.col("turn"), i, other)
    for i in range(4):
        out = out.withColumn("l", (F.col("l") + move(F.lit(i), F.col("r"))) % a) if i % 2 == 0 else out.withColumn("r", (F.col("r") + move(F.lit(i), F.col("l"))) % b)

    def on(state: F.Column, i: F.Column) -> F.Column:
        left, right = state["l"], state["r"]
        step = F.when(i % 2 == 0, F.struct(((left + move(i, right)) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + move(i, left)) % b).alias("r")))
        return step

    def turn(state: F.Column) -> F.Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(3)), state, on)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), F.struct("l", "r"), lambda state, _: F.when(state["l"] * b + state["r"] < n, state).otherwise(turn(state)))
    index = F.when(F.col("l") * b + F.col("r") < n, F.struct("l", "r")).otherwise(walk)
    return out.withColumn("to", index).withColumn("block", F.col("to.l") * b + F.col("to.r")).drop("a", "b", "turn", "x", "l", "r", "to")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds weight and target to (source, source_size): sources by code point, null last, weigh `weights`
    in turn and share the sum of sizes; none gets over `cap` times its size, the excess going to the
    others by weight. With sources sorted by the level at which they are full, the level reached is
    the one at the first source that isn't full."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(cap)
    out = sizes.withColumn("weight", w.cast("double")).withColumn("fill", full / F.col("weight"))
    by = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("level", (F.sum("source_size").over(everything) - before) / weight)
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(everything)["level"]
    out = out.withColumn("reached", level)
    return out.withColumn("target", F.coalesce(F.least(full, F.col("weight") * F.col("reached")), full)).drop("fill", "level", "reached")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    block: int = 64,
    shard: int = 4096,
    seed: int = 0,
) -> Mix:
    """Mix all rows of `docs`. Words are packed into blocks of `block` words, source by source in
    pseudorandom order of rows. Counts of sources per output shard of about `shard` slots are drawn by
    residual sampling: each gets the whole part of its expected slots, and a multinomial draw for the
    fractions alone, so that sources come nearer their targets than by one draw for all slots. The
    slots of a source then run through all its blocks before any comes again, each time in another order.

    A null text or one without words has size 0 and is never taken; null is a source of its own, the
    last; a null doc_id and repeated rows are rows like others; an empty table gives empty results;
    other columns are ignored. Reruns agree, whatever the partitions. No block is taken over `cap`
    (rounded down) times, so no document gives more than that times its size. A hot source is cut
    into 1024 parts by hash for the packing, and its blocks are keys of their own."""
    scratch = Scratch(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    rows = scratch.keep(rows.select("*", key, number(F.lit(seed), F.col("doc_id")).alias("place")))

    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, cap)
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.col("target") * n_blocks / F.col("source_size")).otherwise(0.0)
    sources = scratch.keep(sources.withColumn("n_blocks", n_blocks).withColumn("n_slots", slots))
    known = sources.agg(F.count("*"), F.sum("n_slots")).first()
    small = F.broadcast if known[0] <= FEW else lambda df: df
    n_shards = max(1, -(-int(known[1] or 0) // shard))

    # Packing: offset of each part of a source, then of each row in its part.
    rows = rows.withColumn("part", F.pmod(F.col("place"), F.lit(1024)))
    parts = rows.groupBy("key", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("key", "part", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("at"))
    inside = Window.partitionBy("key", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.filter("size > 0")
    packed = some.select("doc_id", "key", "size", "part", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("in"))
    packed = packed.join(parts, ["key", "part"]).select("doc_id", "key", "size", (F.col("in") + F.col("at")).alias("start"))
    at = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    segments = packed.select("*", at.alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    segments = segments.select("*", (first - F.col("start")).alias("first"), (last - first).alias("words"))

    # Draws: the fractions of all sources end to end, cut at whole numbers, are what a draw hits.
    each = sources.filter("n_slots > 0").withColumn("each", F.col("n_slots") / n_shards)
    each = each.withColumn("whole", F.floor("each")).withColumn("fraction", F.col("each") - F.col("whole"))
    by = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.select("key", "fraction", F.sum("fraction").over(by).alias("hi")).withColumn("lo", F.col("hi") - F.col("fraction"))
    cells = ends.select("key", "lo", "hi", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("cell"))
    total = ends.agg(F.max("hi")).first()[0] or 0.0
    shards = docs.sparkSession.range(n_shards).withColumnRenamed("id", "shard")
    n_draws = F.lit(int(total)) + (uniform(F.lit(seed), F.col("shard"), F.lit("n")) < total - int(total)).cast("int")
    draws = shards.select("shard", F.explode(F.sequence(F.lit(1), F.lit(int(total) + 1))).alias("draw")).filter(F.col("draw") <= n_draws)
    draws = draws.withColumn("u", uniform(F.lit(seed), F.col("shard"), F.col("draw")) * total).withColumn("cell", F.floor("u"))
    hits = draws.join(small(cells), "cell").filter("lo <= u and u < hi").groupBy("shard", "key").agg(F.count("*").alias("more"))
    # Numbers of slots before a shard's: whole ones by its number, drawn ones summed by groups of shards, then inside a group.
    hits = scratch.keep(hits.withColumn("group", F.floor(F.col("shard") / SHARDS)))
    groups = hits.groupBy("key", "group").agg(F.sum("more").alias("n"))
    grid = each.select("key", "n_blocks", "whole", F.explode(F.sequence(F.lit(0), F.lit((n_shards - 1) // SHARDS)).cast("array<bigint>")).alias("group"))
    grid = grid.join(groups, ["key", "group"], "left")
    grid = grid.withColumn("earlier", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("key").orderBy("group")) - F.coalesce("n", F.lit(0))).drop("n")
    last = F.least(F.col("group") * SHARDS + SHARDS, F.lit(n_shards)) - 1
    counts = grid.withColumn("shard", F.explode(F.sequence(F.col("group") * SHARDS, last))).join(hits.drop("group"), ["key", "shard"], "left")
    counts = counts.withColumn("more", F.coalesce("more", F.lit(0)))
    drawn = F.sum("more").over(Window.partitionBy("key", "group").orderBy("shard")) - F.col("more")
    counts = counts.withColumn("begin", F.col("whole") * F.col("shard") + F.col("earlier") + drawn).withColumn("n", F.col("whole") + F.col("more")).filter("n > 0")

    # Slots: the j-th slot of a source takes block j of its current pass, through a permutation of indices. Shards of all sources are dealt out first.
    counts = counts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "shard")
    slots = counts.select("shard", "key", "n_blocks", F.posexplode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("slot", "j"))
    slots = slots.filter(F.col("j") < F.col("n_blocks") * int(cap))
    slots = permuted(slots, seed).select("shard", "slot", "key", "block")

    times = slots.groupBy("key", "block").agg(F.count("*").alias("times"))
    taken = segments.join(times, ["key", "block"]).groupBy("doc_id", "key", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = packed.join(taken.drop("doc_id"), ["key", "start"], "left").select("doc_id", "key", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = rows.filter("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"))
    done = taken.unionByName(none).join(small(sources.select("key", "source_size", "target")), "key")
    return Mix(sources, segments, slots, done.select("doc_id", "size", "source_size", "target", "taken"))
