"""Registration of queries. A query is a function (spark, sf_dir) -> DataFrame, or Spark SQL over
views of the tables it names; its oracle is SQL for DuckDB over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run `text` with a temporary view for each table of the data set that it names. The views are
    resolved when the plan is analysed, so later calls on another folder don't change this frame."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function, with its oracle if SQL can express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL; without `oracle` the text itself is valid in both dialects."""
    query(name, oracle or text)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))
