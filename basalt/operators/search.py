"""Full-text search: postings tables, BM25, fuzzy terms, facets."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, eq, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as analysis
from basalt.scratch import keep


@dataclass
class Index:
    """postings: (term, doc, tf, positions); lengths: (doc, length) of documents with tokens."""

    postings: DataFrame
    lengths: DataFrame


def build(docs: DataFrame, doc: str, text: str, tokens: Callable[[Column], Column] = analysis.tokens) -> Index:
    """Tokens are made in column expressions; one shuffle brings the postings of a term and document together."""
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    each = rows.select("doc", F.posexplode("t").alias("pos", "term"))
    postings = each.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return Index(postings, rows.select("doc", F.size("t").alias("length")))


def term_counts(docs: DataFrame, doc: str, text: str, tokens: Callable[[Column], Column] = analysis.tokens) -> DataFrame:
    """(term, docs, n) over the postings of build(): documents with the term and occurrences. A row's own tokens are sorted
    and the first of each run counts for the document, so all combines by term before the shuffle; only where ids of
    documents repeat are postings made."""
    ids = docs.groupBy(doc).agg(F.count("*").alias("n")).filter("n > 1")
    if not ids.isEmpty():
        return build(docs, doc, text, tokens).postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))
    t = F.sort_array(tokens(F.col(text)))
    # outer, as Spark would put a filter on the size of other arrays below, which cuts texts once more
    runs = docs.select(t.alias("t")).select(F.posexplode_outer("t").alias("pos", "term"), "t").filter("term IS NOT NULL")
    first = (F.col("pos") == 0) | (F.get("t", F.col("pos") - 1) != F.col("term"))
    return runs.select("term", first.cast("long").alias("first")).groupBy("term").agg(F.sum("first").alias("docs"), F.count("*").alias("n"))


def terms(query: str, spark) -> list[str]:  # noqa: ANN001
    """The query's distinct terms, in order."""
    found = spark.range(1).select(analysis.tokens(F.lit(query))).first()[0]
    return list(dict.fromkeys(found))


def bm25(index: Index, wanted: list[str], k: int | None = None, require_all: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) of documents with any (or all) of the terms, best first, ties to the smaller doc.
    idf is ln((N - df + 0.5) / (df + 0.5) + 1). The postings scan prunes by term; the statistics are
    one row each and are broadcast."""
    some = index.postings.filter(F.col("term").isin(wanted)).select("term", "doc", "tf")
    df = some.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    stats = index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    rows = some.join(index.lengths, "doc").join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    out = rows.groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
    out = (out.filter(F.col("hits") == len(wanted)) if require_all else out).select("doc", "score").orderBy(F.desc("score"), "doc")
    return out.limit(k) if k is not None else out


def bm25_scan(
    docs: DataFrame, doc: str, text: str, wanted: list[str], k: int | None = None, require_all: bool = False, tokens: Callable[[Column], Column] = analysis.tokens, k1: float = 1.2, b: float = 0.75,
    match: Callable[[Column, str], Column] = eq,
) -> DataFrame:
    """As bm25(), without an index: texts are cut once, and only a length and the counts of the wanted
    terms are written for each document; statistics (one row) and scores come from those. No shuffle but the last sort.
    `match` says whether a token is a wanted term, where tokens aren't terms themselves."""
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: match(x, w)))
    rows = keep(rows.select("doc", F.size("t").alias("length"), *[count(w).alias(f"tf{i}") for i, w in enumerate(wanted)]))
    rows = rows.filter("length > 0")
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    parts = []
    for i in range(len(wanted)):
        idf, tf = math.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5) + 1), F.col(f"tf{i}")
        parts.append(F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(stats["mean"]))))
    hit = [F.col(f"tf{i}") > 0 for i in range(len(wanted))]
    rows = rows.filter(reduce(and_ if require_all else or_, hit, F.lit(bool(require_all and wanted))))
    out = rows.select("doc", reduce(add, parts, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc")
    return out.limit(k) if k is not None else out


def fuzzy_terms(index: Index, wanted: str, distance: int) -> DataFrame:
    """(term) of the index within `distance` edits of `wanted`. Length prunes before edits are counted."""
    vocabulary = index.postings.select("term").distinct().filter(F.abs(F.length("term") - len(wanted)) <= distance)
    return vocabulary.filter(F.levenshtein(F.col("term"), F.lit(wanted), distance) >= 0)


def fuzzy(index: Index, wanted: list[str], distance: int, k: int | None = None) -> DataFrame:
    """BM25 summed over every term near a term of the query."""
    near = None
    for w in wanted:
        near = fuzzy_terms(index, w, distance) if near is None else near.union(fuzzy_terms(index, w, distance))
    some = index.postings.join(near.distinct(), "term", "left_semi")
    df = some.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    rows = some.join(index.lengths, "doc").join(df, "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    out = rows.groupBy("doc").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "doc")
    return out.limit(k) if k is not None else out


def facets(index: Index, wanted: list[str], docs: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(field, value, n) over all documents with any of the terms."""
    hits = index.postings.filter(F.col("term").isin(wanted)).select(F.col("doc").alias(doc)).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return docs.join(hits, doc, "left_semi").select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
