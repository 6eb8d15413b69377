"""Joins that Spark has no operator for."""

from __future__ import annotations

from math import ceil, degrees, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.scratch import keep


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], inner: bool = True) -> DataFrame:
    """Each left row with the `values` of the latest right row of its key at or before its time. Ties in
    right time go to the greatest values. Left rows without one are dropped, or kept with nulls if not
    `inner`. One shuffle by key: both sides are stacked and the last right row is carried forward, so a
    key's rows are sorted, not multiplied."""
    mine = [c for c in left.columns if c not in by]
    l_rows = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__left"), F.struct(*mine).alias("__row"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema[0].dataType).alias("__v"))
    r_rows = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__left"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__ts", "__left", "__v").rowsBetween(Window.unboundedPreceding, 0)
    out = l_rows.unionByName(r_rows).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__left = 1")
    out = out.filter(F.col("__v").isNotNull()) if inner else out
    return out.select(*by, "__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= at < hi. Ranges are dealt to the bins of `width` that they touch, so that the
    join is an equi-join on bins; choose a width near that of the ranges. Points keep one bin, so no pair is found twice."""
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    found = points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, "__bin")
    return found.filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bin")


#: The sphere's radius in metres (fixed value).
EARTH = 6_371_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres over a sphere of radius 6 371 000 m, from degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Rows of a side of a part of a cell, rows that a task takes, pairs that it measures.
ROWS, TAKEN, MEASURED = 2000, 500_000, 20_000_000


def radius_join(a: DataFrame, b: DataFrame, radius_m: float, lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> DataFrame:
    """Pairs within `radius_m` by haversine, anywhere on the globe. A grid of bands as high as the radius
    is cut, band by band, into cells as wide as the radius reaches there (a band near a pole is one
    cell), counted around the globe, so that the date line is no edge. Rows of `b` are copied to the
    cells beside their own in three bands, then pairs of equal cells are measured. Of a cell with over `ROWS`
    rows of a side, that side is dealt to parts and the other is copied to each, so no cell is one task's.
    Chords decide but for pairs near the radius; those are measured by haversine."""
    half = min(radius_m / EARTH / 2, pi / 2)
    high = max(degrees(2 * half) * 1.001, 1e-6)

    def cells(band: Column) -> Column:
        edge = F.greatest(F.abs((band - 1) * high - 90), F.abs((band + 2) * high - 90))  # bands beside it included
        reach = F.when(edge >= 90, 1.0).otherwise(F.least(F.lit(1.0), F.lit(sin(half)) / F.cos(F.radians(edge))))
        return F.greatest(F.lit(1.0), F.floor(359.9 / F.degrees(2 * F.asin(reach)))).cast("long")

    def cell(lon: Column, n: Column) -> Column:
        return F.least((F.pmod(lon + 180, F.lit(360.0)) * n / 360).cast("long"), n - 1)

    def unit(lat: str, lon: str, side: str) -> list[Column]:
        y, x = F.radians(lat), F.radians(lon)
        return [(F.cos(y) * F.cos(x)).alias(f"__x{side}"), (F.cos(y) * F.sin(x)).alias(f"__y{side}"), F.sin(y).alias(f"__z{side}")]

    band = lambda lat: F.floor((lat + 90) / high)
    left = a.withColumn("__y", band(F.col(lat_a))).withColumn("__x", cell(F.col(lon_a), cells(F.col("__y"))))
    right = b.withColumn("__y", F.explode(F.array(*[band(F.col(lat_b)) + d for d in (-1, 0, 1)])))
    n = cells(F.col("__y"))
    right = right.withColumn("__x", F.explode(F.array_distinct(F.array(*[F.pmod(cell(F.col(lon_b), n) + d, n) for d in (-1, 0, 1)]))))

    counts = [df.groupBy("__y", "__x").agg(F.count("*").alias(c)) for df, c in ((left, "__l"), (right, "__r"))]
    cells_of = keep(counts[0].join(counts[1], ["__y", "__x"], "full").na.fill(0, ["__l", "__r"]))
    rows, pairs = cells_of.agg(F.sum(F.col("__l") + F.col("__r")), F.sum(F.col("__l").cast("double") * F.col("__r"))).first()
    tasks = min(max(ceil((rows or 0) / TAKEN), ceil((pairs or 0) / MEASURED), 1), 10_000)
    dealt = lambda c: F.greatest(F.ceil(F.col(c) / ROWS), F.lit(1)).alias(c)
    hot = F.broadcast(cells_of.filter((F.col("__l") > ROWS) | (F.col("__r") > ROWS)).select("__y", "__x", dealt("__l"), dealt("__r")))
    all_parts = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(c), F.lit(1)) - 1))
    one_part = lambda df, c: F.pmod(F.xxhash64(*[f for f in df.columns if "map<" not in df.schema[f].dataType.simpleString()]), F.coalesce(F.col(c), F.lit(1)))
    left = left.join(hot, ["__y", "__x"], "left").withColumn("__i", one_part(a, "__l")).withColumn("__j", all_parts("__r")).drop("__l", "__r")
    right = right.join(hot, ["__y", "__x"], "left").withColumn("__j", one_part(b, "__r")).withColumn("__i", all_parts("__l")).drop("__l", "__r")
    key = ["__y", "__x", "__i", "__j"]
    left = left.select("*", *unit(lat_a, lon_a, "a")).repartition(tasks, *key)
    right = right.select("*", *unit(lat_b, lon_b, "b")).repartition(tasks, *key)

    square = lambda c: (F.col(f"__{c}a") - F.col(f"__{c}b")) * (F.col(f"__{c}a") - F.col(f"__{c}b"))
    chord, most = square("x") + square("y") + square("z"), 4 * sin(half) ** 2
    unsure = most * 1e-9 + 1e-14 * most**0.5 + 1e-28
    metres = haversine(F.col(lat_a), F.col(lon_a), F.col(lat_b), F.col(lon_b))
    near = (chord <= most + unsure) & ((chord < most - unsure) | (metres <= radius_m))
    if radius_m >= pi * EARTH:
        near = metres <= radius_m
    found = left.join(right.hint("merge"), key).filter(near)
    return found.drop(*key, *[f"__{c}{s}" for c in "xyz" for s in "ab"]).withColumn("metres", metres)
