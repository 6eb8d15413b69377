"""Tables written on the way: iterative operators cut their lineage with them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, as in
    tests on one machine, a temporary folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="basalt-core-"))
    return _own[0]


def keep(df: DataFrame) -> DataFrame:
    """Write `df` in the shared folder and return a frame that reads it: what runs on it starts from
    files, whichever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/basalt-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
