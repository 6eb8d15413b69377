"""Structured Streaming: windows with watermarks, stream logs with consumer groups, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, ts: str, length: str, late: str, by: list[str] = (), slide: str | None = None, value: str = "value") -> DataFrame:
    """count, sum, min, max by window and keys; rows later than the watermark are dropped and counted in
    the query's metrics. `slide` gives sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "sum", "min", "max")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there as Parquet, exactly once, and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class StreamLog:
    """An append-only log of entries (ms, seq, fields). Ids are ms-seq and grow; a log that is opened again
    goes on from its last id. One writer at a time."""

    SCHEMA = "ms long, seq long, fields map<string,string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, (-1, -1)
        try:
            found = self.read().agg(F.max(F.struct("ms", "seq"))).first()[0]
            self.last = tuple(found) if found else self.last
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise

    def add(self, entries: list[tuple[int, dict[str, str]]]) -> list[str]:
        """XADD of a batch of (ms, fields)."""
        rows = []
        for ms, fields in entries:
            self.last = (ms, 0) if ms > self.last[0] else (self.last[0], self.last[1] + 1)
            rows.append((*self.last, fields))
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return [f"{a}-{b}" for a, b, _ in rows]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def range(self, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None, count: int | None = None, reverse: bool = False) -> DataFrame:
        """XRANGE, XREVRANGE: inclusive ends."""
        rows, at = self.read(), F.struct("ms", "seq")
        point = lambda p: F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]).cast("long"))
        rows = rows.filter(at >= point(start)) if start else rows
        rows = rows.filter(at <= point(end)) if end else rows
        rows = rows.orderBy(F.desc("ms"), F.desc("seq")) if reverse else rows.orderBy("ms", "seq")
        return rows.limit(count) if count is not None else rows

    def after(self, last: tuple[int, int], count: int | None = None) -> DataFrame:
        """XREAD: ids greater than `last`."""
        rows = self.read().filter((F.col("ms") > last[0]) | ((F.col("ms") == last[0]) & (F.col("seq") > last[1]))).orderBy("ms", "seq")
        return rows.limit(count) if count is not None else rows

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.path)


class ConsumerGroup:
    """Delivery and pending entries of one group, as tables beside the log: what was delivered to whom,
    and what was acknowledged. New entries are those delivered to nobody."""

    def __init__(self, log: StreamLog, path: str):
        self.log, self.path, self.n = log, path, 0
        spark = log.spark
        spark.createDataFrame([], "ms long, seq long, consumer string").write.parquet(f"{path}/delivered")
        spark.createDataFrame([], "ms long, seq long").write.parquet(f"{path}/acked")

    def _table(self, name: str) -> DataFrame:
        return self.log.spark.read.schema("ms long, seq long" + ", consumer string" * (name == "delivered")).parquet(f"{self.path}/{name}")

    def read(self, consumer: str, count: int) -> list[tuple[int, int]]:
        """XREADGROUP >: the next `count` entries, now pending for the consumer."""
        new = self.log.read().join(self._table("delivered"), ["ms", "seq"], "left_anti").orderBy("ms", "seq").limit(count)
        got = [(r.ms, r.seq) for r in new.select("ms", "seq").collect()]
        if got:
            self.log.spark.createDataFrame([(*g, consumer) for g in got], "ms long, seq long, consumer string").write.mode("append").parquet(f"{self.path}/delivered")
        return got

    def ack(self, ids: list[tuple[int, int]]) -> None:
        self.log.spark.createDataFrame(ids, "ms long, seq long").write.mode("append").parquet(f"{self.path}/acked")

    def pending(self) -> DataFrame:
        return self._table("delivered").join(self._table("acked"), ["ms", "seq"], "left_anti")


def change_feed(stream: DataFrame, key: list[str], path: str, checkpoint: str, apply: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """CDC: every micro-batch is a part of a change table, with its batch and a sequence in it. A batch
    that is run again overwrites its part, so no change is told twice."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if apply:
            apply(batch, n)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def result_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a live query has to tell: rows gone and rows new, with repeats."""
    gone = before.exceptAll(after).withColumn("change", F.lit("deleted"))
    return gone.unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))
