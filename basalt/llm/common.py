"""What the corpus operators share: table access, shared scratch space, skew-safe lookup, workers' memory."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds over 1/HOT_SHARE of the rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Bits of the table that marks keys: 2048 rows of 4 KB, whatever the input.
BITS = 1 << 26

_own_dir: list[str] = []
#: What operators remember in this worker: by operator, what makes them forget it.
_remembered: dict[str, Callable[[], None]] = {}


def take_turn(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called in a worker as a task begins: what other operators remember there goes. Spark uses workers
    again, so that those of one stage would else hold theirs beside what the next one needs."""
    others = [k for k in _remembered if k != operator]
    for k in others:
        _remembered.pop(k)()
    if others:
        give_back()
    if forget:
        _remembered[operator] = forget


def give_back() -> None:
    """Return freed memory to the system, as a task ends: the worker stays, idle or not, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset,
    as in tests on one machine, a temporary folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="basalt-"))
    return _own_dir[0]


class Scratch:
    """Tables written in the shared folder, so that lineage ends there: a lost executor costs only
    the tasks that it ran, and reading again reads files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/basalt-{uuid.uuid4().hex}"
        self.n = 0

    def new(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write `df` and return a frame that reads it."""
        path = self.new()
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._basalt_path = path
        return out

    def sweep(self) -> None:
        """Have shuffles deleted that only ended writes read: Spark does so when the driver's memory is cleared."""
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete what keep() wrote for these; they must not be read again."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._basalt_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join of `rows` to `found`, which has one row for each value of `key`, with in column `n`
    the number of `rows` of that value. Rows of a hot key never meet in one task: as hot keys hold
    over 1/HOT_SHARE of `total` rows each, the at most HOT_SHARE rows found for them are broadcast."""
    least = max(2, total // HOT_SHARE)
    hot = F.broadcast(found.filter(F.col(n) > least).withColumn("__hot", F.lit(True)).limit(HOT_SHARE))
    cold = found.filter(F.col(n) <= least)
    marked = rows.join(hot, key, "left")
    columns = [c for c in [*rows.columns, *found.columns] if c != key]
    own = [c for c in rows.columns if c != key]
    hit = marked.filter(F.col("__hot")).select(key, *columns)
    rest = marked.filter(F.col("__hot").isNull()).select(key, *own).join(cold, key, "left").select(key, *columns)
    return hit.unionByName(rest)


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose `key` isn't in `keys`, by a bit table of fixed size that is
    broadcast: none that is in `keys` goes, and what it leaves in error a join drops."""
    spot = F.pmod(F.xxhash64(key), F.lit(BITS))
    bits = keys.select(spot.alias("__spot")).groupBy(F.bitmap_bucket_number("__spot").alias("__bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__spot")).alias("__bits"))
    place = F.bitmap_bit_position("__spot")
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__spot", spot).withColumn("__bucket", F.bitmap_bucket_number("__spot")).join(F.broadcast(bits), "__bucket")
    found = found.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__spot) % 8 as int))")) != 0)
    return found.select(*rows.columns)
