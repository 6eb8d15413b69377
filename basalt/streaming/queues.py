"""Publish and subscribe, job queues and schedules over append-only tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Channels:
    """Messages (channel, sent, payload) in a table; subscribers stream it, filtered by channel."""

    SCHEMA = "channel string, sent timestamp, payload string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, channel: str, *payloads: str) -> None:
        rows = self.spark.createDataFrame([(channel, p) for p in payloads], "channel string, payload string")
        rows.select("channel", F.current_timestamp().alias("sent"), "payload").write.mode("append").parquet(self.path)

    def channels(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).select("channel").distinct()

    def subscribe(self, channel: str, checkpoint: str, receive: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
        """Each message once to `receive`, in batches; with `every` on and on, else what is there."""
        stream = self.spark.readStream.schema(self.SCHEMA).parquet(self.path).filter(F.col("channel") == channel)
        q = stream.writeStream.foreachBatch(receive).option("checkpointLocation", checkpoint)
        return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def runnable(jobs: DataFrame, attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Jobs (job, priority, …) to run next, greatest priority first: not done, and failed less often than
    `max_attempts`. attempts is (job, ok)."""
    tried = attempts.groupBy("job").agg(F.bool_or("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    left = jobs.join(tried, "job", "left").filter(~F.coalesce("done", F.lit(False)) & (F.coalesce("failed", F.lit(0)) < max_attempts))
    return left.drop("done", "failed").orderBy(F.desc("priority"), "job")


def dead_letters(jobs: DataFrame, attempts: DataFrame, max_attempts: int) -> DataFrame:
    failed = attempts.groupBy("job").agg(F.bool_or("ok").alias("done"), F.count("*").alias("n")).filter((~F.col("done")) & (F.col("n") >= max_attempts))
    return jobs.join(failed, "job", "left_semi")


def due(schedules: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Schedules (name, every_ms or null for once, start) whose next run is due at `now`, given runs (name, at)."""
    last = runs.groupBy("name").agg(F.max("at").alias("last"))
    next_run = F.when(F.col("last").isNull(), F.col("start")).otherwise(F.col("last") + F.col("every_ms"))
    return schedules.join(last, "name", "left").withColumn("next", next_run).filter(F.col("next") <= now).drop("last")


def expire(entries: DataFrame, now: int) -> DataFrame:
    """What a sweep leaves of (…, expires_at)."""
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def trim(entries: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """XTRIM: the latest `keep` entries of each stream."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entries.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")
