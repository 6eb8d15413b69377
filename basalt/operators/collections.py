"""Key-value collections as keyed frames. A log of commands (seq, key, …) is the source of truth; each
function folds it into a state with aggregations that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strings(log: DataFrame, now: int | None = None) -> DataFrame:
    """Latest (key, value) of (seq, key, value, expires_at) commands; null values are deletions, and
    what expired at `now` is gone."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "seq").alias("s")).select("key", "s.*")
    live = last.filter(F.col("value").isNotNull())
    return live.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)) if now is not None else live


def ttl(state: DataFrame, now: int) -> DataFrame:
    """(key, ttl): seconds left, -1 without expiry."""
    return state.select("key", F.when(F.col("expires_at").isNull(), -1).otherwise(F.ceil((F.col("expires_at") - now) / 1000)).cast("long").alias("ttl"))


def set_if_absent(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.unionByName(new.join(state, "key", "left_anti"), allowMissingColumns=True)


def increments(log: DataFrame) -> DataFrame:
    """(key, value) sums of (key, delta)."""
    return log.groupBy("key").agg(F.sum("delta").alias("value"))


def glob(key: Column, pattern: str) -> Column:
    """KEYS: `*` any run, `?` one character."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern)
    return key.rlike(f"^{escaped}$")


def lists(log: DataFrame) -> DataFrame:
    """(key, items) of (seq, key, side, value): pushes to the left come first, latest first."""
    left = F.transform(F.filter("l", lambda x: x["side"] == "left"), lambda x: x["value"])
    right = F.transform(F.filter("l", lambda x: x["side"] != "left"), lambda x: x["value"])
    all_ = log.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "side", "value"))).alias("l"))
    return all_.select("key", F.concat(F.reverse(left), right).alias("items"))


def list_range(items: Column, start: int, stop: int) -> Column:
    """LRANGE: inclusive, negative from the end."""
    n = F.size(items)
    a = F.greatest(F.lit(start) + (n if start < 0 else 0), F.lit(0))
    b = F.least(F.lit(stop) + (n if stop < 0 else 0), n - 1)
    return F.when(a <= b, F.slice(items, a + 1, b - a + 1)).otherwise(F.slice(items, 1, 0))


def hashes(log: DataFrame) -> DataFrame:
    """(key, fields) maps of (seq, key, field, value); null values are deletions."""
    last = log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value")).filter(F.col("value").isNotNull())
    return last.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def sets(log: DataFrame) -> DataFrame:
    """(key, member) of (seq, key, member, added)."""
    last = log.groupBy("key", "member").agg(F.max_by("added", "seq").alias("added"))
    return last.filter("added").select("key", "member")


def set_operation(members: DataFrame, keys: list[str], how: str) -> DataFrame:
    """SINTER, SUNION, SDIFF over (key, member): members of all keys, of any, of the first only."""
    by = members.filter(F.col("key").isin(keys)).groupBy("member").agg(F.collect_set("key").alias("k"))
    test = {"inter": F.size("k") == len(set(keys)), "union": F.lit(True), "diff": (F.size("k") == 1) & F.array_contains("k", keys[0])}
    return by.filter(test[how]).select("member")


def sorted_sets(log: DataFrame) -> DataFrame:
    """(key, member, score, rank): rank from 0 by score, then member."""
    last = log.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score")).filter(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("key").orderBy("score", "member")) - 1
    return last.withColumn("rank", rank)


def distinct_estimate(rows: DataFrame, key: str, value: str) -> DataFrame:
    """PFCOUNT by key, from sketches of precision 14 that merge."""
    sketches = rows.groupBy(key).agg(F.hll_sketch_agg(F.col(value), F.lit(14)).alias("s"))
    return sketches.select(key, F.hll_sketch_estimate("s").alias("n"))


def bits(rows: DataFrame, key: str, offset: str) -> DataFrame:
    """BITCOUNT by key of the offsets set."""
    return rows.groupBy(key).agg(F.count_distinct(offset).alias("bits"))


def list_commands(log: DataFrame) -> DataFrame:
    """(key, items) after (seq, key, command, value) with commands lpush, rpush, lpop and rpop, in order of
    seq; a pop of an empty list does nothing. A key's commands are folded in one row, as its list is one."""
    ordered = log.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "command", "value"))).alias("l"))
    none = F.array().cast(f"array<{log.schema['value'].dataType.simpleString()}>")

    def step(s: Column, c: Column) -> Column:
        fewer = F.greatest(F.size(s) - 1, F.lit(0))
        pushed = F.when(c["command"] == "lpush", F.array_prepend(s, c["value"])).when(c["command"] == "rpush", F.array_append(s, c["value"]))
        return pushed.when(c["command"] == "lpop", F.slice(s, 2, fewer)).when(c["command"] == "rpop", F.slice(s, 1, fewer)).otherwise(s)

    return ordered.select("key", F.aggregate("l", none, step).alias("items"))


def bitmaps(log: DataFrame) -> DataFrame:
    """SETBIT: the (key, offset) that are set after (seq, key, offset, bit)."""
    last = log.groupBy("key", "offset").agg(F.max_by("bit", "seq").alias("bit"))
    return last.filter("bit = 1").select("key", "offset")


def bit_operation(state: DataFrame, keys: list[str], how: str) -> DataFrame:
    """BITOP and, or, xor over (key, offset): the offsets set in the result."""
    by = state.filter(F.col("key").isin(keys)).groupBy("offset").agg(F.count_distinct("key").alias("n"))
    return by.filter({"and": F.col("n") == len(set(keys)), "or": F.lit(True), "xor": F.col("n") % 2 == 1}[how]).select("offset")


def bit_position(state: DataFrame, bit: int) -> DataFrame:
    """BITPOS: (key, position) of the first offset that is set, or of the first that isn't: 0, or the least
    offset behind one that is set."""
    if bit:
        return state.groupBy("key").agg(F.min("offset").alias("position"))
    offset = F.col("offset").cast("long")
    behind = state.select("key", (offset + 1).alias("offset")).union(state.select("key", F.lit(0).cast("long")).distinct())
    return behind.join(state.withColumn("offset", offset), ["key", "offset"], "left_anti").groupBy("key").agg(F.min("offset").alias("position"))


def geo_sets(log: DataFrame) -> DataFrame:
    """GEOADD: (key, member, lon, lat), the last of (seq, key, member, lon, lat)."""
    return log.groupBy("key", "member").agg(F.max_by(F.struct("lon", "lat"), "seq").alias("at")).select("key", "member", "at.*")


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """GEODIST: the great-circle distance of two places in degrees."""
    x = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6_371_000) * F.asin(F.sqrt(F.least(F.lit(1.0), x)))


def geo_radius(state: DataFrame, key: str, lon: float, lat: float, radius: float) -> DataFrame:
    """GEORADIUS: (member, distance) within `radius` metres of a place."""
    d = metres(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    return state.filter(F.col("key") == key).select("member", d.alias("distance")).filter(F.col("distance") <= radius)


def geo_radius_by_member(state: DataFrame, key: str, member: object, radius: float) -> DataFrame:
    """GEORADIUSBYMEMBER: (member, distance); the member itself is one of them. Its place is one row."""
    at = F.broadcast(state.filter((F.col("key") == key) & (F.col("member") == member)).select(F.col("lon").alias("__lon"), F.col("lat").alias("__lat")).limit(1))
    d = metres(F.col("__lon"), F.col("__lat"), F.col("lon"), F.col("lat"))
    return state.filter(F.col("key") == key).join(at).select("member", d.alias("distance")).filter(F.col("distance") <= radius)
