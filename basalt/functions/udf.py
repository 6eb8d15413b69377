"""User-defined functions in Arrow batches, aggregates and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def scalar(f, result: str):  # noqa: ANN001, ANN201
    """A Python function of single values, run over batches; nulls are not passed to it."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None or v is pd.NA else f(v)), result)


def aggregate(f, result: str):  # noqa: ANN001, ANN201
    """A function of a group's values. It needs the group in one task: keep it for groups of bounded size."""

    def run(v: pd.Series) -> object:
        return f(v)

    run.__annotations__ = {"v": pd.Series, "return": float if result == "double" else int if result in ("int", "long", "bigint") else str}
    return F.pandas_udf(run, result)


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate composed of built-in ones, as most can be; it combines before the shuffle."""
    return F.sum(value * weight) / F.sum(weight)


@udtf(returnType="n: bigint")
class Series:
    """generate_series as a table function: inclusive, also downwards; step 0 is an error."""

    def eval(self, start: int, stop: int, step: int):  # noqa: ANN201
        if step == 0:
            raise ValueError("step size cannot be zero")
        n = start
        while (n <= stop) if step > 0 else (n >= stop):
            yield (n,)
            n += step


def install(spark: SparkSession) -> None:
    spark.udtf.register("generate_series_rows", Series)
