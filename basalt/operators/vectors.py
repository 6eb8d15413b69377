"""Dense and sparse vector search. Distances are column expressions over array<double>."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Smaller is nearer; the inner product is negated.
DISTANCES = {"l2": l2, "cosine": cosine, "inner": lambda a, b: -dot(a, b)}


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """Exact k nearest of (id, v, …) to one query, filtered first: a scan and a bounded sort."""
    rows = vectors.filter(where) if where is not None else vectors
    d = DISTANCES[metric](F.col("v").cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("distance", d).orderBy("distance", "id").limit(k)


def exact(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, added in the order of the column expressions, so that the bits are equal."""

    def total(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x))
        for i in range(x.shape[1]):
            s += x[:, i] * y[:, i]
        return s

    with np.errstate(all="ignore"):
        if metric == "l2":
            return np.sqrt(total(v - q, v - q))
        return -total(v, q) if metric == "inner" else 1 - total(v, q) / np.sqrt(total(v, v) * total(q, q))


def nearest(v: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of v for each row of q as (row of q, row of v, distance), ties to the first rows of v. A product of
    matrices leaves those that may be among them; their distances are exact."""
    k, out = min(k, len(v)), []
    with np.errstate(all="ignore"):
        vv, qq = (v * v).sum(1), (q * q).sum(1)
        room = 4 * (v.shape[1] + 4) * 2.0**-52
        for at in range(0, len(q), 512):
            some, norm = q[at : at + 512], qq[at : at + 512, None]
            near, slack = -(some @ v.T), room * np.sqrt(norm * vv.max())
            if metric == "l2":
                near, slack = norm + vv + 2 * near, room * (norm + vv.max())
            elif metric == "cosine":
                near, slack = near / np.sqrt(norm * vv), np.full_like(norm, room)
            last = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero(~(near > last + 2 * slack))  # what is no number stays for the exact distances
            ends = np.searchsorted(row, np.arange(len(some) + 1))
            i = 0
            while i < len(some):  # rows of q with about 200 000 candidates
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + 200_000, "right")) - 1)
                r, c = row[ends[i] : ends[j]], col[ends[i] : ends[j]]
                d = exact(v[c], some[r], metric)
                order = np.lexsort((c, d, r))
                r, c, d = r[order], c[order], d[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((r[first] + at, c[first], d[first]))
                i = j
    return tuple(np.concatenate(x) for x in zip(*out))


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", limit: int = 10_000) -> DataFrame:
    """(query_id, id, distance, rank) for any number of queries (id, v). Both sides are dealt to blocks of up to about
    `limit` rows, and each pair of blocks is multiplied in one task, which keeps k rows for each query; these are
    ranked overall. A vector that is null, has a null or another length than the query has no distance and comes last."""
    vectors, queries = vectors.select("id", "v"), queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    across, down = (max(1, ceil(df.count() / limit)) for df in (vectors, queries))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("x", block("id", across).cast("int")).withColumn("y", every(down))
    right = queries.withColumn("y", block("query_id", down).cast("int")).withColumn("x", every(across))
    kind, query_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def search(v: pa.Table, q: pa.Table) -> pa.Table:
        v = v.sort_by("id").combine_chunks() if v.num_rows else v
        found = [(q["query_id"].slice(0, 0), v["id"].slice(0, 0), pa.array([], pa.float64()))] if v.num_rows and q.num_rows else []
        v_len, q_len = lengths(v["v"]), lengths(q["q"])
        for n in np.unique(q_len) if found else ():
            mine, fit = np.flatnonzero(q_len == n), np.flatnonzero(v_len == n) if n >= 0 else np.array([], int)
            if len(fit):
                r, c, d = nearest(matrix(v["v"], fit, n), matrix(q["q"], mine, n), k, metric)
                found.append((q["query_id"].take(pa.array(mine[r])), v["id"].take(pa.array(fit[c])), pa.array(d)))
            if len(fit) < k:  # without a distance
                others = np.setdiff1d(np.arange(v.num_rows), fit)[: k - len(fit)]
                found.append((q["query_id"].take(pa.array(np.repeat(mine, len(others)))), v["id"].take(pa.array(np.tile(others, len(mine)))), pa.nulls(len(mine) * len(others), pa.float64())))
        if not found:
            return pa.table({"query_id": q["query_id"].slice(0, 0), "id": v["id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        return pa.concat_tables([pa.table({"query_id": a, "id": b, "distance": c}) for a, b, c in found])

    near = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(search, f"query_id {query_kind}, id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def lengths(v: pa.ChunkedArray) -> np.ndarray:
    """The length of each list; -1 for a null and for one with a null in it."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(v)
    if flat.null_count:
        n[np.unique(pc.list_parent_indices(v).to_numpy(zero_copy_only=False)[pc.is_null(flat).to_numpy(zero_copy_only=False)])] = -1
    return n


def matrix(v: pa.ChunkedArray, rows: np.ndarray, n: int) -> np.ndarray:
    flat = pc.list_flatten(v.combine_chunks().take(pa.array(rows)))
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)


class Ivf:
    """Inverted lists: k-means cells, of which a search scans the `probes` nearest."""

    def __init__(self, vectors: DataFrame, lists: int, seed: int = 0, sample: float = 1.0):
        rows = vectors.withColumn("__v", array_to_vector(F.col("v").cast("array<double>")))
        train = rows.sample(sample, seed) if sample < 1 else rows
        self.model = KMeans(k=lists, seed=seed, featuresCol="__v", predictionCol="list", maxIter=10).fit(train)
        self.rows = self.model.transform(rows).drop("__v")

    def search(self, query: list[float], k: int, probes: int) -> DataFrame:
        """The centers are as many as there are lists, so the driver ranks them; the scan prunes by list."""
        order = sorted(enumerate(self.model.clusterCenters()), key=lambda c: sum((float(x) - y) ** 2 for x, y in zip(c[1], query)))
        return knn(self.rows.filter(F.col("list").isin([i for i, _ in order[:probes]])), query, k)


def sparse_top_k(postings: DataFrame, query: dict[int, float], k: int) -> DataFrame:
    """(id, score) by dot product over postings (id, dim, weight), best first, ties to the smaller id."""
    q = F.create_map(*[x for d, w in query.items() for x in (F.lit(d), F.lit(float(w)))])
    some = postings.filter(F.col("dim").isin(list(query)))
    out = some.groupBy("id").agg(F.sum(F.col("weight") * F.element_at(q, F.col("dim"))).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """(id, score): both (id, score) lists divided by their greatest score, alpha of the dense one."""
    top = lambda df, name: df.join(F.broadcast(df.agg(F.max("score").alias("m")))).select("id", F.when(F.col("m") > 0, F.col("score") / F.col("m")).otherwise(0.0).alias(name))
    both = top(dense, "d").join(top(sparse, "s"), "id", "full")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each beginning `overlap` before the last one's end."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
