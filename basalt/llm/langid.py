"""Language identification by script, word scores and Viterbi (operator 2)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import give_back, take_turn

#: A word: letters that touch.
WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges (fixed values of the Unicode blocks), each up to the next.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Yi"), (0xA720, "Latin"),
    (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFF66, "Kana"), (0x20000, "Han"),
]
STARTS = [a for a, _ in SCRIPTS]
#: Words whose scores a task remembers, none longer than LONGEST letters; words scored at once.
REMEMBERED, SCORED = 200_000, 5_000
#: Characters of texts that are labelled side by side, about, or one text more; texts taken from a batch at once.
AT_ONCE, TEXTS = 500_000, 64
#: Longest run of letters scored as one word; longer ones, as in scripts without spaces, are cut.
LONGEST = 64


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(letter)) - 1][1]


def words(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if found and max(map(len, found)) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def grams(word: str) -> list[str]:
    """Runs of one to three letters, with marks at the ends of the word, and the word itself."""
    w = f"<{word}>"
    two = list(map(add, w, w[1:]))
    return [*w, *two, *map(add, two, w[2:]), "=" + word]


@dataclass
class Model:
    """Runs of letters, logarithms of their shares in each language (a row for each, and a last one for
    runs never seen), and the languages of scripts."""

    langs: list[str]
    grams: list[str]
    table: np.ndarray
    scripts: dict[str, list[int]]
    prior: int = 0
    penalty: float = 8.0
    cache: dict[str, int] = field(default_factory=dict)

    def score(self, found: list[str]) -> np.ndarray:
        """A row of scores for each word, one for each language; those that don't use the word's script
        are ruled out, unless none does."""
        if "place" not in self.__dict__:
            self.place = {g: i for i, g in enumerate(self.grams)}
        get, none = self.place.get, len(self.place)
        flat = list(map(get, chain.from_iterable(map(grams, found)), repeat(none)))
        n = np.array([3 * len(w) + 4 for w in found])  # runs of one, two, three letters of <word>, and the word
        total = np.add.reduceat(self.table[flat], np.cumsum(n) - n, axis=0) / 3  # each letter is in about three runs
        by: dict[str, list[int]] = {}
        for k, w in enumerate(found):
            by.setdefault(w[0], []).append(k)
        for c, at in by.items():
            able = self.scripts.get(script(c))
            if able is None:
                total[at] = 0
            elif len(able) < len(self.langs):
                total[np.ix_(at, [i for i in range(len(self.langs)) if i not in able])] = -1e4
        return np.maximum(total - total.max(1, keepdims=True), -50.0)

    def forget(self) -> None:
        """Let go of the words remembered; the next text begins anew."""
        self.cache.clear()
        for name in ("place", "rows", "letters", "known"):
            self.__dict__.pop(name, None)

    def index(self, found: list[list[str]]) -> list[np.ndarray]:
        """Where the words of each text are in rows (scores), letters and known (script of a language)."""
        for _ in range(2):
            got = [list(map(self.cache.get, f)) for f in found]
            new = list(dict.fromkeys(w for f, k in zip(found, got) if None in k for w, i in zip(f, k) if i is None))
            if self.cache and len(self.cache) + len(new) > REMEMBERED:
                self.cache.clear()
                continue
            break
        if new:
            used = len(self.cache)
            self.cache.update(zip(new, range(used, used + len(new))))
            parts = [self.score(new[i : i + SCORED]) for i in range(0, len(new), SCORED)]
            fresh = (np.concatenate(parts).astype(np.float32), np.array([len(w) for w in new]), np.array([script(w[0]) in self.scripts for w in new]))
            if not used or used + len(new) > len(self.rows):
                room = max(REMEMBERED, used + len(new)) if used else max(2 * len(new), 1)
                old = (self.rows[:used], self.letters[:used], self.known[:used]) if used else tuple(a[:0] for a in fresh)
                self.rows, self.letters, self.known = (np.concatenate([a, np.zeros((room - used, *b.shape[1:]), b.dtype)]) for a, b in zip(old, fresh))
            for a, b in zip((self.rows, self.letters, self.known), fresh):
                a[used : used + len(new)] = b
            got = [list(map(self.cache.get, f)) if None in k else k for f, k in zip(found, got)]
        return [np.array(k, np.int64) for k in got]

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Where the words of each text are, and their languages, by Viterbi over all texts side by
        side: staying in a language costs nothing, switching costs the penalty."""
        found = self.index([words(t) if t else [] for t in texts])
        order = sorted((i for i in range(len(texts)) if len(found[i])), key=lambda i: -len(found[i]))
        out = [(f, np.empty(0, np.int8)) for f in found]
        if not order:
            return out
        lens = np.array([len(found[i]) for i in order])
        starts = np.cumsum(lens) - lens
        longest = int(lens[0])
        active = np.searchsorted(-lens, -np.arange(longest), side="left")  # texts with over t words
        # The t-th words of all texts stand together, longest text first: the place of each text's words.
        begins = np.cumsum(active) - active
        text = np.repeat(np.arange(len(lens)), lens)
        place = begins[np.arange(len(text)) - starts[text]] + text
        rows = np.empty(len(place), np.int64)
        rows[place] = np.concatenate([found[i] for i in order])
        s = np.ascontiguousarray(self.rows[rows].T)  # scores; in place of them what each language is behind the best before the word
        steps = list(zip(begins.tolist(), active.tolist()))
        v, best = s[:, : len(lens)].copy(), np.maximum.reduce
        for a, n in steps[1:]:
            head, here = v[:, :n], s[:, a : a + n]
            behind = head - best(head, 0)
            np.maximum(behind, -self.penalty, out=head)
            head += here
            here[:] = behind
        moved = s.argmax(0).astype(np.int8)  # the best language before each word
        # The language before each word, for each that the word may have.
        came = np.where(s >= -self.penalty, np.arange(len(s), dtype=np.int8)[:, None], moved).T.ravel()
        at = np.arange(0, len(came), len(s))
        path = np.empty(len(place), np.int8)
        path[place[starts + lens - 1]] = v.argmax(0)
        for (before, _), (a, n) in zip(steps[-2::-1], steps[:0:-1]):
            path[before : before + n] = came.take(at[a : a + n] + path[a : a + n])
        path = path[place]
        for i, a, n in zip(order, starts.tolist(), lens.tolist()):
            out[i] = (found[i], path[a : a + n])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of most letters, and their share of the letters; without letters und, 0.
        Ties go to the language first in order. If no language uses the script, the commonest, 0."""
        out = []
        for k, path in self.label(texts):
            if not len(k):
                out.append(("und", 0.0))
                continue
            n, known = self.letters[k], self.known[k]
            if not known.any():
                out.append((self.langs[self.prior], 0.0))
                continue
            by = np.bincount(path[known], n[known], len(self.langs))
            out.append((self.langs[int(by.argmax())], float(by.max() / n.sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, words, language) for each span of one language."""
        _, path = self.label([text])[0]
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
        return [(int(a), int(b - a), self.langs[path[a]]) for a, b in zip(cuts, cuts[1:]) if b > a]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, sample: int = 4000, penalty: float = 8.0) -> Model | None:
    """Learn from rows of `docs` with text and lang, at most `sample` of them: the first by `order`,
    by default a hash of the text. Their whole texts are counted on the executors; only counts of runs
    of letters come back, so the model's size is bounded by the sample. None if there is nothing to
    learn from. Words count once in each text, so that repetition doesn't distort shares."""
    place = F.xxhash64(text) if order is None else order
    kept = docs.select(place.alias("place"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    last = kept.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]  # places alone are sorted
    kept = kept.filter(F.col("place") <= F.lit(last)).orderBy("place", "text", "lang").limit(sample).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("langid")
        n: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = set(words(t))
                n.update((k, g) for w in found for g in grams(w))
                n.update((k, "#" + script(c)) for w in found for c in w)
                n[k, "@"] += 1
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([g for _, g in keys], pa.string()), pa.array([n[x] for x in keys], pa.int64())], ["lang", "gram", "n"])
        del n, keys
        give_back()

    found = kept.repartition(12).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = found.filter("n > 1 or gram like '#%' or gram = '@'").toPandas()
    if not len(found):
        return None
    langs = sorted(set(found.lang))
    at = {k: i for i, k in enumerate(langs)}
    by: dict[str, list[float]] = {}
    for k, g, n in found.itertuples(index=False):
        by.setdefault(g, [0.0] * len(langs))[at[k]] = float(n)
    texts = by.pop("@")
    marks = {g: by.pop(g) for g in [g for g in by if g[0] == "#" and len(g) > 1]}
    counts = np.array([*by.values(), [0.0] * len(langs)])
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(by) + 1)).astype(np.float32)
    letters = [sum(v[k] for v in marks.values()) or 1.0 for k in range(len(langs))]
    scripts = {g[1:]: able for g, v in marks.items() if (able := [k for k in range(len(langs)) if v[k] >= 0.01 * letters[k]])}
    return Model(langs, list(by), table, scripts, texts.index(max(texts)), penalty)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with columns lang_pred and score (0 to 1) more (or in place of such columns). A text that
    is null or has no letter gets und and 0, as all do without a model. Whole texts are read; repeated
    rows and other columns stay as they are; an empty table gives no rows. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learnt from

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_turn("langid")
        model = shared.value
        for b in batches:
            lang, score = [], []
            texts, size = [], 0
            for k, t in enumerate(x for lo in range(0, len(b), TEXTS) for x in b.slice(lo, TEXTS).to_pylist()):
                texts.append(t)
                size += len(t or "")
                if size >= AT_ONCE or k == len(b) - 1:
                    got = model.predict(texts) if model else [("und", 0.0)] * len(texts)
                    lang += [x for x, _ in got]
                    score += [x for _, x in got]
                    texts, size = [], 0
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
        if model:
            model.forget()
        give_back()

    take = F.arrow_udf(_typed(run), "lang_pred string, score double")
    got = docs.drop("lang_pred", "score").withColumn("__lang", take(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in got.columns if c != "__lang"], "__lang.lang_pred", "__lang.score")


def _typed(f):  # noqa: ANN001, ANN202
    """Give the function the annotations that arrow_udf reads."""
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, lang) for each span of one language in each text, words counted from
    0. Null texts and texts without letters have no spans; null ids and repeated rows are rows like
    others; an empty table gives no rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in shared.value.spans(t)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "first_word", "n_words", "lang"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, first_word long, n_words long, lang string")
