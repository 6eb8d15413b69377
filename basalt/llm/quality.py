"""Quality classifier: a sparse ensemble of rules (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "!#$%&*+/<=>@[]^_`{|}~\\"


def statistics(text: Column) -> dict[str, Column]:
    """What rules may ask of a whole text; null counts as empty. Words are cut at white space."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    without = lambda chars: n - F.length(F.translate(t, chars, ""))
    share = lambda x, of: x / F.greatest(of, F.lit(1))
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "n_chars": n.cast("double"),
        "n_words": n_words.cast("double"),
        "word_chars": share(n, n_words),
        "distinct_words": share(distinct, n_words),
        "distinct_root": share(distinct, F.sqrt(n_words)),
        "n_lines": F.size(lines).cast("double"),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_chars": share(n, F.size(lines)),
        "upper": share(without(UPPER), n),
        "symbols": share(without(SYMBOLS), n),
        "digits": share(without("0123456789"), n),
        "stops": share(without(".?!"), n_words),
        "commas": share(without(",;:"), n_words),
        "bars": share(without("|"), n_words),
    }


@dataclass
class Rule:
    """A conjunction of conditions (statistic, at most or not, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.logical_and.reduce([(x[:, names.index(s)] <= t) == most for s, most, t in self.conditions])

    def column(self) -> Column:
        return reduce(Column.__and__, [F.col(s) <= t if most else F.col(s) > t for s, most, t in self.conditions])


@dataclass
class Model:
    bias: float
    rules: list[Rule]

    def score(self) -> Column:
        """The probability of a good text, over columns with the names of the statistics."""
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(), r.weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def paths(x: np.ndarray, y: np.ndarray, names: list[str], depth: int, rng: np.random.Generator) -> list[Rule]:
    """Grow a tree by least squared error on random halves of the statistics; a rule for each node's path."""
    out: list[Rule] = []

    def grow(rows: np.ndarray, conditions: tuple) -> None:
        if len(conditions) >= depth or len(rows) < 20:
            return
        best = (1e-9, None, None)
        total, n = y[rows].sum(), len(rows)
        for k in rng.choice(len(names), max(1, len(names) // 2), replace=False):
            v = x[rows, k]
            order = np.argsort(v, kind="stable")
            s, left = v[order], np.cumsum(y[rows][order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            cut = cut[(cut >= 4) & (cut < n - 5)]
            if len(cut):
                m = cut + 1
                gain = left[cut] ** 2 / m + (total - left[cut]) ** 2 / (n - m) - total**2 / n
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, float((s[cut[i]] + s[cut[i] + 1]) / 2))
        if best[1] is None:
            return
        _, k, t = best
        low = x[rows, k] <= t
        for side, most in ((rows[low], True), (rows[~low], False)):
            here = (*conditions, (names[k], most, t))
            out.append(Rule(here))
            grow(side, here)

    grow(np.arange(len(x)), ())
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty on all but the bias, by accelerated proximal gradient."""
    n, d = z.shape
    mean = z.mean(0)
    zc = z - mean
    step = 4 * n / (np.linalg.norm(zc, 2) ** 2 + n)
    w = v = np.zeros(d + 1)
    w[0] = v[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    k = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(zc @ v[1:] + v[0])))
        g = np.concatenate([[np.mean(p - y)], zc.T @ (p - y) / n])
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v = new + (k - 1) / k2 * (new - w)
        w, k = new, k2
    return float(w[0] - mean @ w[1:]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 0) -> Model:
    """Rules are the paths of trees that each correct those before on a random half of the rows;
    weights are the lasso's. Without rows of both classes the score is the same for all."""
    if not len(y):
        return Model(0.0, [])
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Model(bias, [])
    rng = np.random.default_rng(seed)
    rules: dict[tuple, Rule] = {}
    f = np.full(len(y), bias)
    for _ in range(trees):
        rows = rng.choice(len(y), max(40, len(y) // 2), replace=len(y) < 80)
        residual = y - 1 / (1 + np.exp(-f))
        found = paths(x[rows], residual[rows], names, depth, rng)
        rules |= {r.conditions: r for r in found}
        for r in found:  # leaves of the tree move the scores
            if not any(o.conditions[: len(r.conditions)] == r.conditions and o is not r for o in found):
                hit = r.holds(x, names)
                if hit.any():
                    f[hit] += 0.3 * 4 * residual[hit].mean()
    listed = list(rules.values())
    z = np.stack([r.holds(x, names) for r in listed], 1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)
    listed, z = [listed[i] for i in sorted(first)], z[:, sorted(first)]
    bias, w = lasso(z, y, penalty)
    return Model(bias, [Rule(r.conditions, float(c)) for r, c in zip(listed, w) if abs(c) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most `sample` labelled rows, the first by a hash of the id. Their statistics, never
    their texts, come to the driver. Null labels or ids teach nothing."""
    some = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).dropna()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    stats = statistics(F.col("text"))
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = known.select("doc_id", "y", *[c.alias(k) for k, c in stats.items()])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "n_chars").limit(sample).toPandas()
    return fit(rows[list(stats)].to_numpy(float), rows["y"].to_numpy(float), list(stats))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with a column score (0 to 1) more, or in place of such a column, from the whole text by
    column expressions alone. Null text counts as empty, and empty texts are scored too; repeated rows
    and other columns stay as they are; an empty table gives no rows. No shuffle."""
    stats = statistics(F.col(text))
    own = [c for c in docs.columns if c != "score"]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), *[c.alias(k) for k, c in stats.items()])
    return named.select("__row.*", model.score().alias("score"))
