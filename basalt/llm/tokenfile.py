"""Token ids in files compressed by grammars (operator 5).

A file set is a Parquet table with a row for each shard: part and seq give its place, n_docs and
n_tokens what it holds, first_id and last_id its smallest and largest doc_id, payload the grammar. A payload is little-endian: the magic RPG1; as unsigned
32-bit integers the first nonterminal, the numbers of rules, of symbols and of documents; then unsigned
32-bit arrays: left and right symbols of the rules, expansion lengths of the rules, the sequence, first
symbol and number of tokens of each document; then the documents' ids as signed 64-bit integers and a
byte for each that is 1 where the id is null. No rule spans documents, so one document is read by
expanding its own symbols."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A chunk that is looked up as a word of letters and the marks behind it: letters of Latin, Greek and Cyrillic
#: that stay single letters when the library composes and lowers them.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3E1}\x{400}-\x{481}\x{48A}-\x{52F}"
SIMPLE = rf"^(?P<head>[{LETTERS}]+)(?P<marks>[.,;:!?*%&$#]*)$"
#: Bytes of chunks and ids remembered by one worker, the objects' own size included; longer chunks aren't remembered.
REMEMBERED, OBJECTS, LONGEST = 192 << 20, 170, 256
#: Bytes of texts tokenised at once, about.
AT_ONCE = 8 << 20
MAGIC = b"RPG1"


class Encoder:
    """The library's tokenizer of one file, for tokenizers that drop white space before they look for
    words, so that what stands between white space is encoded alike anywhere; and what a worker
    remembers of it. Strings of special tokens get those tokens' ids, as in the library by default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        suffix, vocabulary = self.library.model.end_of_word_suffix, self.library.get_vocab()
        #: Whether each id ends a word, by the tokenizer's own suffix.
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        #: Whether what comes before the model leaves words of a-z as they are.
        probe = "abcdefghijklmnopqrstuvwxyz"
        normal = self.library.normalizer.normalize_str(probe) if self.library.normalizer else probe
        split = self.library.pre_tokenizer.pre_tokenize_str(normal) if self.library.pre_tokenizer else []
        self.bare = [w for w, _ in split] == [probe]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of each word or chunk
        self.flat, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64)  # all ids by number, with room behind; how many each has
        self.begins = np.empty(0, np.int64)
        self.count = self.end = self.used = 0

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and how many each has."""
        ids = [e.ids for lo in range(0, len(chunks), 20_000) for e in self.library.encode_batch_fast(chunks[lo : lo + 20_000], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), "<u4"), np.array(list(map(len, ids)), np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, lower-case where they are ASCII: those of a-z go to the library's model, if what it has
        before that leaves them as they are; of others many go to the library in one text, in which they come out one by
        one at the ends that it marks. Where a word falls into several, each goes alone."""
        bare = [w for w in words if w.isascii()] if self.bare else []  # of a-z, as words are looked up in lower case: for the model itself
        got = [[t.id for t in found] for found in map(self.library.model.tokenize, bare)]
        out = [(np.array(list(chain.from_iterable(got)), "<u4"), np.array(list(map(len, got)), np.int64))]
        rest = [w for w in words if not w.isascii()] if self.bare else words
        for lo in range(0, len(rest), 2000):
            part = rest[lo : lo + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.final[ids]) + 1
            good = len(cut) == len(part) and cut[-1] == len(ids)
            out.append((ids, np.diff(cut, prepend=0)) if good else self.encode(part))
        ids, n = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
        if bare and rest:
            ascii_ = np.fromiter(map(str.isascii, words), bool, len(words))
            place = np.where(ascii_, np.cumsum(ascii_) - 1, len(bare) + np.cumsum(~ascii_) - 1)
            return gather(ids, (np.cumsum(n) - n)[place], n[place]), n[place]
        return ids, n

    def look_up(self, keys: pa.Array, how: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words or chunks end to end, and how many each has, from memory or, all
        unknown ones together, by `how`. When memory is full, all is forgotten after that."""
        different = keys.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = different if len(fresh) == len(different) else list(map(different.__getitem__, fresh.tolist()))
            ids, n = how(new)
            count, end = self.count + len(n), self.end + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.end], np.empty(max(end, 1 << 16), "<u4")])
            if count > len(self.sizes):
                self.sizes, self.begins = (np.concatenate([x[: self.count], np.empty(max(count, 1 << 14), np.int64)]) for x in (self.sizes, self.begins))
            self.flat[self.end : end], self.sizes[self.count : count], self.begins[self.count : count] = ids, n, self.end + np.cumsum(n) - n
            at[fresh] = np.arange(self.count, count)
            letters = list(map(len, new))
            numbers = range(self.count, count)
            self.known.update(zip(new, numbers) if max(letters) <= LONGEST else ((w, k) for w, k in zip(new, numbers) if len(w) <= LONGEST))
            self.used += sum(letters) + ids.nbytes + OBJECTS * len(new)
            self.count, self.end = count, end
        n = self.sizes[at]
        out = gather(self.flat, self.begins[at], n), n
        if self.used > REMEMBERED:
            self.forget()
        return out

    def tokenize(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; null counts as empty. Each different
        chunk is taken apart once: letters before marks are a word of their own, in lower case like
        all words, so the library sees each such word once; other chunks it sees whole."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, SIMPLE)
        simple = parts.is_valid()
        other = self.look_up(chunks.dictionary.filter(pc.invert(simple)), self.encode)
        parts = parts.filter(simple)
        heads, marks = pc.ascii_lower(parts.field("head")).dictionary_encode(), parts.field("marks").dictionary_encode()
        units = [self.look_up(heads.dictionary, self.words), self.look_up(marks.dictionary, self.encode), other, (np.empty(0, "<u4"), np.zeros(1, np.int64))]
        simple = simple.to_numpy(zero_copy_only=False)
        flat, n = (np.concatenate(x) for x in zip(*units))
        unit = np.full((len(simple), 2), len(n) - 1)  # of each different chunk: word and marks, or itself and nothing
        unit[simple, 0] = heads.indices.to_numpy()
        unit[simple, 1] = len(heads.dictionary) + marks.indices.to_numpy()
        unit[~simple, 0] = len(heads.dictionary) + len(marks.dictionary) + np.arange(len(other[1]))
        at = unit.ravel()
        flat, n = gather(flat, (np.cumsum(n) - n)[at], n[at]), n[unit].sum(1)  # of different chunks
        at = chunks.indices.to_numpy()
        begin, n = (np.cumsum(n) - n)[at], n[at]
        total = np.r_[0, np.cumsum(n)]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return gather(flat, begin, n), np.diff(total[ends], prepend=0)


def gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of `flat` end to end."""
    total = np.cumsum(n)
    at = np.repeat(begin - total + n, n)
    at += np.arange(len(at))
    return flat.take(at)


_loaded: dict[str, Encoder] = {}


def tokenizer(path: str) -> Encoder:
    """One encoder for each worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


@dataclass
class Grammar:
    first: int  # the first nonterminal; rule r makes first + r
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    starts: np.ndarray  # of each document, in the sequence
    tokens: np.ndarray  # of each document
    known: tuple[np.ndarray, np.ndarray] | None = None

    def rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all rules end to end, and where each begins. Rules refer to earlier ones
        only, so they are worked out in stretches that don't refer to themselves."""
        n = self.lengths.astype(np.int64)
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        lo, latest = 0, np.maximum.accumulate(np.maximum(self.left, self.right).astype(np.int64)) if len(n) else n
        while lo < len(n):
            hi = int(np.searchsorted(latest, self.first + lo))
            for side, at in ((self.left[lo:hi], begin[lo:hi]), (self.right[lo:hi], begin[lo:hi] + self.sizes(self.left[lo:hi]))):
                out_at, got = self.copy(side, out, begin)
                shift = at - (np.cumsum(self.sizes(side)) - self.sizes(side))
                out[out_at + np.repeat(shift, self.sizes(side))] = got
            lo = hi
        return out, begin

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        big = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[big] = self.lengths[symbols[big].astype(np.int64) - self.first]
        return out

    def copy(self, symbols: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places 0, 1, … and the ids there, for symbols that stand end to end."""
        n = self.sizes(symbols)
        end = np.cumsum(n)
        out = np.repeat(symbols.astype(np.uint32), n)
        big = np.flatnonzero(symbols >= self.first)
        place = np.arange(int(end[-1]) if len(end) else 0)
        if len(big):
            m = n[big]
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            to = np.repeat(end[big] - m, m) + inside
            out[to] = flat[np.repeat(begin[symbols[big].astype(np.int64) - self.first], m) + inside]
        return place, out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.known is None:
            self.known = self.rules()
        return self.copy(symbols, *self.known)[1]

    def document(self, d: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo..hi of document d, all by default, from its own symbols alone: expansion lengths say
        which symbols reach into the range, and only those are taken apart, level by level."""
        end = self.starts[d + 1] if d + 1 < len(self.starts) else len(self.sequence)
        s, first = self.sequence[self.starts[d] : end], 0
        hi = int(self.tokens[d]) if hi is None else min(hi, int(self.tokens[d]))
        if hi <= lo:
            return np.empty(0, np.uint32)
        while True:
            n = self.sizes(s)
            begin = first + np.cumsum(n) - n
            inside = (begin < hi) & (begin + n > lo)
            s, first = s[inside], int(begin[inside][0])
            big = s >= self.first
            if not big.any():
                return s.astype(np.uint32)
            r = s[big].astype(np.int64) - self.first
            at = np.flatnonzero(big) + np.arange(len(r))
            s = np.repeat(s, 1 + big)
            s[at], s[at + 1] = self.left[r], self.right[r]


def number(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs as 64-bit keys, in order, and which of them each pair is."""
    bits, place = int(max(left.max(), right.max())).bit_length(), len(left).bit_length()
    key = left.astype(np.uint64) << np.uint64(bits) | right
    if 2 * bits + place <= 64:  # places are sorted along in the low bits
        key = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
        order, key = (key & np.uint64((1 << place) - 1)).astype(np.int64), key >> np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    key = key[new]
    return (key >> np.uint64(bits)) << np.uint64(32) | key & np.uint64((1 << bits) - 1), which


def once(x: np.ndarray) -> np.ndarray:
    """The different places of `x`, which is in order or nearly so."""
    if len(x) > 1 and (x[1:] < x[:-1]).any():
        x = np.sort(x, kind="stable")
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def compress(tokens: np.ndarray, counts: np.ndarray, first: int, least: int = 4) -> Grammar:
    """Re-Pair: replace frequent pairs by new symbols, again and again, until no pair occurs `least`
    times. A rule is stored as three numbers, so a pair saves space from four occurrences. One round
    takes all pairs at least 1/32 as frequent as the most frequent one; where chosen pairs overlap,
    the more frequent wins, in runs of one symbol every other. Pairs are counted once; then only
    those beside a replacement are counted anew, all of which hold a new symbol. So counts only fall
    after that, and pairs too rare at first are forgotten."""
    s = tokens.astype(np.uint32)
    starts = np.cumsum(counts) - counts
    made = first
    rules: list[np.ndarray] = []
    pair = np.zeros(len(s), np.intp)  # which pair begins at each place; 0: none that is frequent
    whole = np.ones(len(s), bool)  # whether the pair there lies in one document
    ends = np.append(starts[1:], len(s)) - 1
    whole[ends[ends >= 0]] = False
    keys, n = np.zeros(1, np.uint64), np.zeros(1, np.int64)

    def count(at: np.ndarray) -> None:
        nonlocal keys, n
        if len(at):
            new, which = number(s[at], s[at + 1])
            found = np.bincount(which)
            often = found >= least
            pair[at] = np.where(often, len(keys) - 1 + np.cumsum(often), 0)[which]
            keys, n = np.concatenate([keys, new[often]]), np.concatenate([n, found[often]])

    count(np.flatnonzero(whole))
    while (most := int(n.max())) >= least:
        few = np.flatnonzero(n >= max(least, most // 32))
        few = few[np.argsort(-n[few], kind="stable")]
        rank = np.full(len(keys), -1, np.int32)
        rank[few] = np.arange(len(few))
        r = rank.take(pair)
        at = np.flatnonzero(r >= 0)
        r = r[at].astype(np.int64)
        beside = np.diff(at) == 1
        run = np.flatnonzero(np.concatenate([[True], ~beside | (np.diff(r) != 0)]))
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) & 1
        value = r * 2 + odd
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | (value[1:] < value[:-1])
        wins[:-1] &= ~beside | (value[:-1] < value[1:])
        at, r = at[wins], r[wins]
        hits = np.bincount(r, minlength=len(few)) > 0
        rules.append(keys[few[hits]])
        # Pairs that go: the replaced ones and those that overlap them.
        n -= np.bincount(pair[once(np.stack([np.maximum(at - 1, 0), at, at + 1], 1).ravel())], minlength=len(n))
        n[0] = 0
        s[at] = (made + np.cumsum(hits) - 1)[r].astype(np.uint32)
        made += int(hits.sum())
        whole[at] = whole[at + 1]
        starts = starts - np.searchsorted(at, starts)  # each pair replaced before a start moves it by one
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        s, pair, whole = s.take(stay), pair.take(stay), whole.take(stay)
        at -= np.arange(len(at))
        beside = once(np.stack([np.maximum(at - 1, 0), at], 1).ravel())
        pair[beside] = 0
        count(beside[whole[beside]])
    rule = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    left, right = (rule >> np.uint64(32)).astype(np.uint32), (rule & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lengths = np.ones(made, np.uint32)
    base = first
    for k in rules:
        lengths[base : base + len(k)] = lengths[left[base - first :][: len(k)]] + lengths[right[base - first :][: len(k)]]
        base += len(k)
    return Grammar(first, left, right, lengths[first:], s, starts, counts)


def pack(g: Grammar, ids: list[int | None]) -> bytes:
    head = struct.pack("<4I", g.first, len(g.left), len(g.sequence), len(ids))
    arrays = [x.astype("<u4").tobytes() for x in (g.left, g.right, g.lengths, g.sequence, g.starts, g.tokens)]
    nulls = bytes(i is None for i in ids)
    return b"".join([MAGIC, head, *arrays, np.array([i or 0 for i in ids], "<i8").tobytes(), nulls])


def unpack(data: bytes) -> tuple[Grammar, list[int | None]]:
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    first, rules, symbols, docs = struct.unpack_from("<4I", data, 4)
    at, got = 20, []
    for n in (rules, rules, rules, symbols, docs, docs):
        got.append(np.frombuffer(data, "<u4", n, at))
        at += 4 * n
    ids = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = data[at + 8 * docs : at + 9 * docs]
    return Grammar(first, *got[:4], got[4].astype(np.int64), got[5].astype(np.int64)), [None if z else i for i, z in zip(ids, nulls)]


#: Columns of a file set.
FIELDS = "part int, seq int, n_docs long, n_tokens long, first_id long, last_id long, payload binary"
SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("payload", pa.binary())])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (id, text) batches, cut so that texts of a piece have about AT_ONCE bytes, or one text more."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
        lo = 0
        while lo < b.num_rows:
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + AT_ONCE, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def write(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, doc_id: str = "doc_id", text: str = "text", vocabulary: int = 49408, shard: int = 1 << 20) -> None:
    """Write the ids of all texts, each with `end_id` behind it, in ascending order of doc_id (nulls
    first) to shards of about `shard` ids in the file set `out`. Null text counts as empty; repeated
    rows are written as often as given; an empty table gives a file set without shards. Every executor
    must have the tokenizer's file. Rows are dealt by ranges of doc_id, which are unique in a corpus;
    a task holds one shard at a time."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = tokenizer(tokenizer_path)
        ids: list[int | None] = []  # documents of the shard that is being filled, their numbers of tokens, their tokens
        counts: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, ids, counts, held
            data = pack(compress(np.concatenate(held), np.array(counts, np.int64), vocabulary), ids)
            known = [i for i in ids if i is not None]
            values = [part, seq, len(ids), sum(counts), min(known, default=None), max(known, default=None), data]
            row = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, SHARD)], schema=SHARD)
            seq, ids, counts, held = seq + 1, [], [], []
            return row

        size = 0
        for some in pieces(batches):
            flat, n = encoder.tokenize(some.column(1))
            at = np.cumsum(n)
            flat = np.insert(flat, at, end_id)
            ends = (at + np.arange(1, len(n) + 1)).tolist()
            done, begin, names = 0, 0, some.column(0).to_pylist()
            for k, end in enumerate(ends):
                size += end - (ends[k - 1] if k else 0)
                if size >= shard or k + 1 == len(ends):
                    ids += names[done : k + 1]
                    counts += (n[done : k + 1] + 1).tolist()
                    held.append(flat[begin:end])
                    done, begin = k + 1, end
                    if size >= shard:
                        yield close()
                        size = 0
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows.mapInArrow(run, FIELDS).write.parquet(out)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids]) for each document in the file set: start is the
    number of ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                g, docs = unpack(data)
                flat = g.expand(g.sequence).astype("<u4")
                at = np.r_[0, np.cumsum(g.tokens)]
                for lo in range(0, len(docs), 512):
                    some = range(lo, min(lo + 512, len(docs)))
                    texts = [flat[at[d] : at[d + 1]] for d in some]
                    out = [pa.array([part] * len(some), pa.int32()), pa.array([seq] * len(some), pa.int32()), pa.array([docs[d] for d in some], pa.int64()), pa.array([int(at[d]) for d in some], pa.int64())]
                    out += [pa.array([len(x) for x in texts], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in texts], pa.int64())]
                    names = ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"]
                    if ids:
                        out, names = [*out, pa.array([x.astype(np.int32) for x in texts], pa.list_(pa.int32()))], [*names, "token_ids"]
                    yield pa.RecordBatch.from_arrays(out, names)

    shards = spark.read.schema(FIELDS).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    begin = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    begins = sizes.select("part", "seq", begin.alias("begin")).join(parts, "part").select("part", "seq", (F.col("begin") + F.col("before")).alias("begin"))
    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * ids
    docs = shards.select("part", "seq", "payload").mapInArrow(run, schema).join(begins, ["part", "seq"])
    more = ["token_ids"] * ids
    return docs.select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *more)


def fetch(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, token_ids) of the documents with these ids, a short list: shards without them aren't read,
    and of the others only the documents' own symbols are expanded. Repeated rows come as often as written."""
    wanted = set(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                g, docs = unpack(data)
                at = [d for d, i in enumerate(docs) if i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([docs[d] for d in at], pa.int64()), pa.array([g.document(d).astype(np.int32) for d in at], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    near = F.exists(F.array(*map(F.lit, sorted(wanted))), lambda i: i.between(F.col("first_id"), F.col("last_id"))) if wanted else F.lit(False)
    if wanted:
        near &= (F.col("first_id") <= max(wanted)) & (F.col("last_id") >= min(wanted))  # for the statistics of files
    return spark.read.schema(FIELDS).parquet(path).filter(near).select("payload").mapInArrow(run, "doc_id long, token_ids array<int>")
