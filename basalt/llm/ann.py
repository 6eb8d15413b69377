"""Nearest neighbours by multiprobe p-stable hashing (operator 3)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import HOT_SHARE, Scratch

#: Rows of the index that meet in one cell, about; queries of a cell scored at once.
CELL, BLOCK = 16_384, 256


@dataclass
class Index:
    """Hash functions of all tables over vectors scaled to the longest and given one more component that
    makes them unit vectors, so that the largest inner product is the least distance."""

    longest: float
    a: np.ndarray  # tables x functions x (dims + 1)
    b: np.ndarray
    width: float
    closeness: float  # cosine that near neighbours have
    success: float  # share of neighbours that each table's probes are to reach
    cells: int
    salts: dict[int, int]  # sub-buckets of hot buckets

    def project(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        n = np.linalg.norm(x, axis=1)
        u = x / (n[:, None] if query else self.longest)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (n / self.longest) ** 2))
        return np.column_stack([u, last]) @ self.a[table].T

    def keys(self, table: int, h: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row of bucket numbers."""
        out = np.full(len(h), 0x9E3779B97F4A7C15 * (table + 1) % (1 << 64), np.uint64)
        for column in h.T.astype(np.int64).view(np.uint64):
            out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(2)).astype(np.int64)

    def cell(self, key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (key + salt * 7919) % self.cells

    def probes(self, f: np.ndarray) -> list[tuple[int, ...]]:
        """Buckets for the projections of one query, in falling order of the estimated chance that a
        neighbour is there, until the chances add up to the success asked for. A neighbour's projection
        is normal around the query's, drawn in by the closeness."""
        s = sqrt(max(1e-6, 1 - self.closeness**2))
        choices = []
        for x, b in zip(f, self.b_now):
            mid = int(np.floor((self.closeness * x + b) / self.width))
            at = range(mid - 12, mid + 13)
            cdf = [0.5 * (1 + erf((k * self.width - b - self.closeness * x) / s / sqrt(2))) for k in [*at, mid + 13]]
            p = [(hi - lo, k) for lo, hi, k in zip(cdf, cdf[1:], at)]
            choices.append(sorted((c for c in p if c[0] > 1e-9), reverse=True))
        heap = [(-float(np.prod([c[0][0] for c in choices])), (0,) * len(choices))]
        seen, out, reached = {heap[0][1]}, [], 0.0
        while heap and reached < self.success:
            p, at = heapq.heappop(heap)
            reached -= p
            out.append(tuple(c[i][1] for c, i in zip(choices, at)))
            for k, i in enumerate(at):
                after = (*at[:k], i + 1, *at[k + 1 :])
                if i + 1 < len(choices[k]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (p * choices[k][i + 1][0] / choices[k][i][0], after))
        return out

    def use(self, table: int) -> Index:
        self.b_now = self.b[table]
        return self


def stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def sound(v: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, all components finite."""
    limit = F.lit(float("inf"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def build(vectors: DataFrame, tables: int, functions: int, width: float, recall: float, k: int, seed: int, sample: int) -> Index | None:
    """Draw the functions; estimate how close neighbours are from at most `sample` vectors, the first by
    a hash of their ids; count every bucket."""
    n, longest = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return None
    some = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)
    unit = some / np.linalg.norm(some, axis=1, keepdims=True)
    cos = np.sort(unit[:200] @ unit.T, axis=1)[:, ::-1]
    closeness = float(np.clip(np.median(cos[:, min(len(some) - 1, max(1, round(k * len(some) / n)))]), 0.0, 0.95))
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((tables, functions, some.shape[1] + 1))
    b = rng.uniform(0, width, (tables, functions))
    cells = max(12, -(-n * tables // CELL))
    index = Index(float(longest), a, b, width, closeness, 1 - (1 - recall) ** (1 / tables), cells, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stack(batch.column(0))
            for t in range(tables):
                key, n = np.unique(index.keys(t, np.floor((index.project(x, t, False) + b[t]) / width)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    limit = max(256, n // HOT_SHARE)
    counts = vectors.select("v").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # Buckets with over 1/HOT_SHARE of the rows: at most HOT_SHARE in each table.
    index.salts = {r.key: -(-r.n // limit) for r in counts.filter(F.col("n") > limit).collect()}
    return index


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = 2,
    functions: int = 6,
    width: float = 1.5,
    recall: float = 0.96,
    seed: int = 0,
    sample: int = 2000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` where `queries` holds, the k other rows
    of largest inner product among the candidates of all tables' probes, scored in double precision
    on the original vectors, nearest first, ties to the smaller vec_id.

    Every row is indexed in every table. `recall` is the share of true neighbours that the probes are
    estimated to reach; the width is in units of the longest vector.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    vectors of another length than the longest, or rows with a null id. Rows that repeat an id count
    once, by the first vector in order. Fewer candidates than k give fewer rows; an empty table none.
    Other columns are ignored. Hot buckets are cut into parts of at most 1/1000 of the rows; a cell
    keeps its part of the index and streams queries by, and sends on k rows for each."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    # Cell tasks hold one part of the index each; queries come in blocks.
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & sound(F.col("v")))
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "q")).alias("x")).select("id", "x.v", "x.q")
    rows = scratch.keep(rows)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    rows = rows.filter(F.size("v") == F.lit(dims or 0))
    index = build(rows.select("id", "v"), tables, functions, width, recall, k, seed, sample)
    if index is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows as (cell, 0, id, v, [key]); queries as (cell, 1, id, v, keys to probe there)."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, ids = stack(part.column(1)), part.column(0).to_numpy()
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                cell, kind, row, keys = [], [], [], []
                for t in range(tables):
                    key = index.keys(t, np.floor((index.project(x, t, False) + index.b[t]) / index.width))
                    salt = np.array([abs(hash(int(i))) % index.salts.get(int(c), 1) for i, c in zip(ids, key)])
                    cell += index.cell(key, salt).tolist()
                    kind += [0] * len(x)
                    row += range(len(x))
                    keys += [[c] for c in key.tolist()]
                    f = index.project(x[asks], t, True) if len(asks) else []
                    for q, projected in zip(asks.tolist(), f):
                        key = index.keys(t, np.array(index.use(t).probes(projected)))
                        many = np.array([index.salts.get(int(c), 1) for c in key])
                        key, salt = np.repeat(key, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        at = index.cell(key, salt)
                        order = np.argsort(at, kind="stable")
                        cuts = np.flatnonzero(np.diff(at[order])) + 1
                        for group in np.split(order, cuts):
                            cell.append(int(at[group[0]]))
                            kind.append(1)
                            row.append(q)
                            keys.append(np.unique(key[group]).tolist())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(kind, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(keys, pa.list_(pa.int64()))],
                    ["cell", "kind", "id", "v", "keys"],
                )

    def score(held: list[pa.RecordBatch], asks: pa.RecordBatch) -> pa.RecordBatch:
        x, ids = np.concatenate([stack(h.column(3)) for h in held]), np.concatenate([h.column(2).to_numpy() for h in held])
        key, at = np.unique(np.concatenate([h.column(4).flatten().to_numpy() for h in held]), return_inverse=True)
        q, qid, lists = stack(asks.column(3)), asks.column(2).to_numpy(), asks.column(4)
        probed = np.zeros((len(q), len(key)), bool)
        owner, wanted = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = key[found] == wanted
        probed[owner[hit], found[hit]] = True
        s = np.where(probed[:, at] & (ids[None, :] != qid[:, None]), q @ x.T, -np.inf)
        edge = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
        out: list[list] = [[], [], []]
        for i in range(len(q)):
            c = np.flatnonzero((s[i] >= edge[i] - 1e-9) & np.isfinite(s[i]))
            exact = (x[c] * q[i]).sum(1)  # the same for equal vectors, whatever stands beside them
            best = np.lexsort((ids[c], -exact))[:k]
            out[0] += [int(qid[i])] * len(best)
            out[1] += ids[c][best].tolist()
            out[2] += exact[best].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell * 2 + kind)) + 1), len(cell)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if cell[lo] != now:
                    held, now = [], cell[lo]
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    for part in range(lo, hi, BLOCK):
                        yield score(held, batch.slice(part, min(BLOCK, hi - part)))

    placed = rows.select(F.col("id").cast("long").alias("id"), "v", "q").mapInArrow(place, "cell long, kind int, id long, v array<double>, keys array<long>")
    placed = placed.repartition("cell").sortWithinPartitions("cell", "kind")
    found = placed.mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
