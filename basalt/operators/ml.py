"""Term weights, simple models, tensors and sequences, as frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as analysis


def term_frequencies(docs: DataFrame, doc: str, text: str, tokens: Callable[[Column], Column] = analysis.tokens) -> DataFrame:
    """(doc, term, tf): the share of a document's tokens that are the term."""
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    each = rows.select("doc", F.size("t").alias("n"), F.explode("t").alias("term"))
    return each.groupBy("doc", "term").agg((F.count("*") / F.first("n")).alias("tf"))


def tf_idf(docs: DataFrame, doc: str, text: str, tokens: Callable[[Column], Column] = analysis.tokens) -> DataFrame:
    """(doc, term, weight): tf · ln(N / df), N being all documents with tokens."""
    tf = term_frequencies(docs, doc, text, tokens)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct("doc").alias("n"))
    return tf.join(df, "term").join(F.broadcast(n)).select("doc", "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("weight"))


def linear(features: list[str], weights: list[float], bias: float) -> Column:
    out = F.lit(float(bias))
    for f, w in zip(features, weights):
        out = out + F.col(f) * float(w)
    return out


def softmax(features: list[str], classes: dict[str, tuple[list[float], float]]) -> dict[str, Column]:
    """Probability of each class, from its weights and bias."""
    scores = {c: linear(features, w, b) for c, (w, b) in classes.items()}
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    parts = {c: F.exp(s - top) for c, s in scores.items()}
    total = sum(parts.values(), F.lit(0.0))
    return {c: p / total for c, p in parts.items()}


def classify(features: list[str], classes: dict[str, tuple[list[float], float]]) -> Column:
    """The class of greatest score, ties to the last by name."""
    best = F.greatest(*[F.struct(linear(features, w, b).alias("s"), F.lit(c).alias("c")) for c, (w, b) in classes.items()])
    return best["c"]


def next_values(rows: DataFrame, order: list[str], start: int = 1, step: int = 1, parts: int = 64) -> DataFrame:
    """`rows` with nextval in `order`: gapless, from two levels of counting, so that no task sees all rows."""
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id() % (1 << 33))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = dealt.join(F.broadcast(before), "__part")
    return out.withColumn("nextval", F.lit(start) + (F.col("__before") + F.col("__id")) * step).drop("__part", "__id", "__before")


def tensor_versions(tensors: DataFrame) -> DataFrame:
    """(name, versions, latest, bytes) of (name, version, shape, data)."""
    return tensors.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"), F.max("version").alias("latest"), F.sum(F.octet_length("data")).alias("bytes"))
