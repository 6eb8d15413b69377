"""Time series: frames of (series, ts, value) with ts in epoch milliseconds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds of named buckets; a month counts as 30 days.
BUCKETS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000}


def bucket(ts: Column, width: str | int) -> Column:
    ms = BUCKETS[width] if isinstance(width, str) else width
    return (F.floor(ts / ms) * ms).cast("long")


AGGREGATES = {
    "count": lambda v, t: F.count(v),
    "sum": lambda v, t: F.sum(v),
    "avg": lambda v, t: F.avg(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "first": lambda v, t: F.min_by(v, t),
    "last": lambda v, t: F.max_by(v, t),
}


def aggregate(points: DataFrame, width: str | int, functions: list[str], by: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Aggregates per series and bucket over start <= ts < end. One partial and one final aggregation."""
    some = between(points, start, end)
    keys = ["series"] if by is None else by
    aggs = [AGGREGATES[f](F.col("value"), F.col("ts")).alias(f) for f in functions]
    return some.groupBy(*keys, bucket(F.col("ts"), width).alias("bucket")).agg(*aggs)


def between(points: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        points = points.filter(F.col("ts") >= start)
    return points.filter(F.col("ts") < end) if end is not None else points


def last_values(points: DataFrame) -> DataFrame:
    """The latest point of each series."""
    best = F.max_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("p")
    return points.groupBy("series").agg(best).select("series", "p.ts", "p.value")


def retain(points: DataFrame, max_age_ms: int, now: int | None = None) -> DataFrame:
    """Points no older than max_age_ms before `now`, by default the latest point."""
    if now is not None:
        return points.filter(F.col("ts") >= now - max_age_ms)
    latest = points.agg(F.max("ts").alias("__now"))  # one row
    return points.join(F.broadcast(latest)).filter(F.col("ts") >= F.col("__now") - max_age_ms).drop("__now")


class ContinuousAggregate:
    """A table of bucket aggregates, kept up to a watermark. refresh() adds the buckets that have closed
    since: those that end at or before the latest point. Points that come late for a bucket below the
    watermark don't change it. Until a first bucket has closed, the open one is kept apart and replaced by
    each refresh. The watermark is in the table itself: another process goes on from it, and a refresh
    that is run again overwrites its own part."""

    def __init__(self, spark: SparkSession, path: str, width: str | int, function: str):
        self.spark, self.path, self.function = spark, path, function
        self.width = BUCKETS[width] if isinstance(width, str) else width
        self.watermark: int | None = None
        try:
            self.watermark = spark.read.parquet(f"{path}/closed").agg(F.max("upto")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise

    def refresh(self, points: DataFrame) -> int | None:
        """Returns the new watermark, the end of the last closed bucket."""
        latest = points.agg(F.max("ts")).first()[0]
        if latest is None:
            return self.watermark
        closed = latest // self.width * self.width
        if self.watermark is not None and closed <= self.watermark:
            return self.watermark
        if self.watermark is None and points.filter(F.col("ts") < closed).isEmpty():
            self.buckets(points).write.mode("overwrite").parquet(f"{self.path}/open")
            return None
        self.buckets(between(points, self.watermark, closed)).write.mode("overwrite").parquet(f"{self.path}/closed/upto={closed}")
        self.watermark = closed
        return closed

    def buckets(self, points: DataFrame) -> DataFrame:
        return aggregate(points, self.width, [self.function]).withColumnRenamed(self.function, "value")

    def query(self, start: int | None = None, end: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/open") if self.watermark is None else self.spark.read.parquet(f"{self.path}/closed").drop("upto")
        return between(rows.withColumnRenamed("bucket", "ts"), start, end).withColumnRenamed("ts", "bucket")
