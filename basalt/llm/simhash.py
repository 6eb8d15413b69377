"""SimHash near-duplicates by anchor-point covering (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from basalt.llm.common import Scratch, give_back, lookup, take_turn
from basalt.llm.components import connected_components

#: Generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code: length 23, covering radius 3, perfect.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3
#: Pairs compared at once.
PAIRS = 2_000_000
#: Rows of one anchor held before they are compared.
HELD = 1_000_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64)
    over = 2 * np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) > len(h)
    return int(np.packbits(over).view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts):  # noqa: ANN001, ANN201
    return texts.map(fingerprint, na_action=None).astype("int64")


@cache
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes of the Golay code, the error patterns of weight up to
    RADIUS + 2: where they start, how many, the patterns, and their weight beyond RADIUS."""
    remainder = [0] * LENGTH
    for i in range(LENGTH):
        r = 1 << i
        for b in range(LENGTH - 1, 10, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - 11)
        remainder[i] = r
    found = []
    for w in range(RADIUS + 3):
        for bits in combinations(range(LENGTH), w):
            s = e = 0
            for b in bits:
                s, e = s ^ remainder[b], e | 1 << b
            found.append((s, max(0, w - RADIUS), e))
    a = np.array(sorted(found), np.int64)
    n = np.bincount(a[:, 0], minlength=2048)
    return np.cumsum(n) - n, n, a[:, 2], a[:, 1]


@cache
def syndromes() -> np.ndarray:
    """The syndrome of every 23-bit word, built up bit by bit."""
    start, n, e, _ = cosets()
    one = {int(x): s for s in range(2048) for x in e[start[s] : start[s] + n[s]] if int(x).bit_count() == 1}
    out = np.zeros(1, np.int16)
    for b in range(LENGTH):
        out = np.concatenate([out, out ^ np.int16(one[1 << b])])
    return out


def forget() -> None:
    cosets.cache_clear()
    syndromes.cache_clear()


def near(word: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word, the code words within RADIUS + room: row, code word, distance beyond RADIUS."""
    start, n, e, over = cosets()
    s = syndromes()[word]
    row = np.repeat(np.arange(len(word)), n[s])
    k = np.arange(len(row)) - np.repeat(np.cumsum(n[s]) - n[s], n[s]) + start[s][row]
    ok = over[k] <= room[row]
    row, k = row[ok], k[ok]
    return row, word[row] ^ e[k], over[k]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors are pairs of Golay code words over bits 0-22 and 23-45. A fingerprint within `threshold`
    bits of another is within radius plus the bits that differ, block by block, of the other's own
    anchor. Returns for each such anchor: row, anchor, whether it is the row's own."""
    mask = (1 << LENGTH) - 1
    row, a, over = near((fps & mask).astype(np.int64), np.full(len(fps), threshold))
    row2, b, over2 = near(((fps >> LENGTH) & mask).astype(np.int64)[row], threshold - over)
    return row[row2], a[row2] << LENGTH | b, (over[row2] + over2) == 0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links a-b, but only one for each node at most."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == was).all():
            break
    k = np.flatnonzero(root != np.arange(len(ids)))
    return ids[k], ids[root[k]]


def compare(anchor: np.ndarray, fp: np.ndarray, own: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints at an anchor (sorted by it) of which one has it as its own."""
    if not len(anchor):
        return
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[edge, len(anchor)])
    group = np.repeat(np.arange(len(edge)), size)
    home = np.flatnonzero(own & (size[group] > 1))
    n = size[group[home]]
    lo = 0
    while lo < len(home):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), PAIRS)) + lo)
        for part in range(0, int(n[lo]) if hi == lo + 1 else 1, PAIRS):
            m = np.minimum(n[lo:hi] - part, PAIRS) if hi == lo + 1 else n[lo:hi]
            i = np.repeat(home[lo:hi], m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + edge[group[i]] + part
            x, y = fp[i], fp[j]
            ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
            if ok.any():
                yield forest(x[ok], y[ok])
        lo = hi


def component_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Fingerprints of `width`-word shingles link at `threshold` (up to 2) or fewer differing bits;
    component_id is the smallest doc_id reachable, itself included. Equal fingerprints are one node, so
    a hot group of copies counts once. Every fingerprint is sent to its own anchor and to all anchors
    within covering radius plus threshold, and compared at each anchor with those whose own it is.

    Null or empty text: fingerprint zero, linked like any other. A null doc_id takes part but is never
    a component_id unless the whole component has none; repeated rows are returned as often as given;
    an empty table gives no rows; other columns are ignored. One bound on rows of a task holds for any
    anchor: rows stream, and only fingerprints whose own anchor it is are held."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    take = F.pandas_udf(lambda t: t.map(lambda x: fingerprint(x, width), na_action=None).astype("int64"), LongType()) if width != 3 else fingerprints
    fps = scratch.keep(docs.select(F.col(doc_id).alias("doc_id"), take(F.col(text)).alias("fp")))
    total = fps.count()
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("simhash", forget)
        for b in batches:
            fp = b.column("fp").to_numpy()
            for lo in range(0, len(fp), 4096):
                part = fp[lo : lo + 4096]
                row, a, own = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(part[row]), pa.array(own)], ["anchor", "fp", "own"])
        give_back()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in compare(*parts, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from out([x[:last] for x in held])
            held = [x[last:] for x in held]
            if len(held[0]) > HELD:  # own ones come first; the rest need not be held once compared
                yield from out(held)
                held = [x[held[2]] for x in held]
        yield from out(held)
        del held
        give_back()

    sent = nodes.select("fp").mapInArrow(replicate, "anchor long, fp long, own boolean")
    sent = sent.repartition("anchor").sortWithinPartitions("anchor", F.desc("own"))
    links = sent.mapInArrow(link, "src long, dst long")
    comp = connected_components(links, scratch).withColumnRenamed("node", "fp")
    known = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = scratch.keep(known)
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(least, "component").select("fp", "n", "component_id")
    done = lookup(fps, known, "fp", "n", total)
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
