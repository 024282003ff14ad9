"""Language-model scoring with an Elias-Fano n-gram trie in shards.

Texts are lower-cased (A-Z) and cut into words; each text closes with one end token. The model has every word of the
training texts and every pair and triple that occurs at least ``LEAST`` times in them, at any size of the corpus, smoothed
by absolute discounting: what a context's n-grams give up goes to the n-grams that are one word shorter, in the end to the
exact unigram probability.

The trie is dealt into shards by a hash of the context. Texts become bundles of tokens, which are stored once. A bundle
asks each shard for its distinct n-grams and tells how often each occurs in its training texts; so what is shuffled grows
with distinct n-grams of bundles, and a key that holds a third of all rows is one ask per bundle. A shard sums the
counts, builds the levels from what is frequent enough, and answers every ask from them, in the order of the asks; answers
need no keys. Bundles then add up their tokens' probabilities.

A level of a shard is a monotone sequence: the position of the context, times the number of words, plus the word. It is
stored in Elias-Fano form (packed low bits, unary high bits with sampled ranks) with pointers from each context to its
successors in the same form, next to smoothed probabilities and back-off weights, quantised to 1,023 levels, and mapped from a
file. A query takes the context's position, looks whether it has successors, and searches for
the word among them.

The most frequent words (at most ``WORDS``) have numbers, which are broadcast; all others are told by hashes and ask for
their counts like n-grams. A context with more than ``HOT`` training tokens (or ``HOT_SHARE`` of all, which bounds their
number) is dealt to several shards by the word that follows; its sums are put together before the texts are scored. None
of these parameters changes a result.

Null texts are empty: the end token alone. With no training texts all counts are 0 and every token has probability 1.
Repeated rows are texts like any other, each counted and scored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .words import SPACED_LOWER, mix, split

#: Occurrences from which a pair or triple belongs to the model.
LEAST = 2
DISCOUNT = 0.75
HELD_OUT = 10
#: Most words that are numbered and broadcast (20 bytes each).
WORDS = 1 << 21
#: Tokens of a bundle and of a shard, about.
BUNDLE = 600_000
SHARD = 500_000
#: Bytes of a text that are cut into words at once.
SLICE = base.PIECE_BYTES
#: Training tokens from which a context is dealt to several shards: the larger of a number and a share of all.
HOT, HOT_SHARE = 500_000, 1e-6
#: Distinct n-grams that a task sums up before it passes them on.
BUFFER = 2_000_000
#: Stands for the end token where words are hashes.
END_HASH = -0x6A09E667F3BCC909
#: A probability of 10 to the -x has the code sqrt(x) times this, which is finest near one; n-grams outside the trie have the last code.
STEPS, ABSENT = 250, 1023
#: Stands for any word without a number where all words that may belong to an n-gram have one.
UNKNOWN = -1
_K = np.uint64(0x9E3779B97F4A7C15)


class EliasFano:
    """A monotone sequence of integers: packed low bits and unary high bits, with the number of ones before each 64 bits."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.size, self.low_bits, self.low, self.high = size, low_bits, low, np.asarray(high).view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)]).astype(np.int32)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(math.log2(max(1, universe / max(1, n)))))
        lows = values & ((1 << bits) - 1)
        plane = ((lows[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1) if bits else np.empty(0, np.uint8)
        low = np.concatenate([np.packbits(plane, bitorder="little"), np.zeros(8, np.uint8)])
        marks = np.zeros(-(-((universe >> bits) + n + 2) // 64) * 64, np.uint8)
        marks[(values >> bits) + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little"))

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        byte, out = at >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th one or zero (from 0)."""
        before = self.ones if bit else (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones)
        word = np.searchsorted(before, k, "right") - 1
        x = self.high[np.minimum(word, len(self.high) - 1)]
        x, left = (x if bit else ~x), (k - before[word]).astype(np.int64)
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= count
            left -= np.where(up, count, 0)
            place += np.where(up, width, 0)
            x = np.where(up, x >> np.uint64(width), x)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i) << self.low_bits) | self.low_at(i)

    def _start(self, high: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is smaller."""
        return np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - np.maximum(high - 1, 0), 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is not in the sequence: a successor search in its high part's stretch."""
        high, want = values >> self.low_bits, values & ((1 << self.low_bits) - 1)
        lo, hi = self._start(high), self._start(high + 1)
        end = hi.copy()
        while True:
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                break
            mid = (lo[busy] + hi[busy]) >> 1
            less = self.low_at(mid) < want[busy]
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        found = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(lo < end)
        same = self.low_at(lo[inside]) == want[inside]
        found[inside[same]] = lo[inside[same]]
        return found


def quantise(logs: np.ndarray) -> np.ndarray:
    """Codes of log10 values of at most 0."""
    return np.clip(np.rint(np.sqrt(np.maximum(-logs, 0)) * STEPS), 0, ABSENT - 1).astype(np.uint16)


#: What codes stand for, as numbers; 0 for absent n-grams.
_VALUES = np.append(10 ** -((np.arange(ABSENT) / STEPS) ** 2), 0.0)


class Level:
    """n-grams of one order in a shard: keys (context, word), pointers of the contexts, codes of probabilities and back-offs."""

    def __init__(self, keys: EliasFano, pointers: EliasFano, words: int, prob: np.ndarray, back: np.ndarray):
        self.keys, self.pointers, self.words, self.prob, self.back = keys, pointers, words, prob, back

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, contexts: int, words: int, prob: np.ndarray, back: np.ndarray) -> Level:
        keys = EliasFano.of(context * words + word, max(1, contexts * words))
        pointers = EliasFano.of(np.searchsorted(context, np.arange(contexts + 1)).astype(np.int64), len(word) + 1)
        return cls(keys, pointers, words, quantise(prob), quantise(back))

    def mapped(self) -> Level:
        """The same level with its parts in a memory-mapped file."""
        parts = [self.keys.low, self.keys.high, self.pointers.low, self.pointers.high, self.prob, self.back]
        with tempfile.TemporaryFile() as file:
            starts = []
            for part in parts:
                file.write(b"\0" * (-file.tell() % 8))
                starts.append(file.tell())
                file.write(part.tobytes())
            file.flush()
            block = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        low, high, plow, phigh, prob, back = (np.frombuffer(block, p.dtype, len(p), s) for p, s in zip(parts, starts))
        return Level(EliasFano(self.keys.size, self.keys.low_bits, low, high), EliasFano(self.pointers.size, self.pointers.low_bits, plow, phigh), self.words, prob, back)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the probabilities of (context, word); ABSENT where the context has no successors or none is the word."""
        out = np.full(len(word), ABSENT, np.uint16)
        has = self.pointers.get(context + 1) > self.pointers.get(context) if self.pointers.size else np.zeros(len(word), bool)
        ask = np.flatnonzero(has & (word >= 0))
        at = self.keys.find(context[ask] * self.words + word[ask])
        out[ask[at >= 0]] = self.prob[at[at >= 0]]
        return out


# -- words


@dataclass
class Vocabulary:
    """Words numbered by falling frequency, with their training counts, and the corpus totals; the end token has the last number."""

    total: int
    types: int
    #: sorted hashes, the number of each, and the counts by number
    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    #: contexts that are dealt to several shards: sorted keys and numbers of shards
    hot: np.ndarray
    splits: np.ndarray
    #: whether every word that occurs ``LEAST`` times has a number
    complete: bool = False
    shards: int = 1

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the numbered words; below -1 for others."""
        rest = -2 - (hashes >> np.uint64(2)).astype(np.int64)
        if not len(self.hashes):
            return rest
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], rest)

    def shard_of(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of n-grams with these context keys and last words."""
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[at] == key)
            key = key.copy()
            key[hot] += mix(word[hot].view(np.uint64) + _K) % self.splits[at[hot]].astype(np.uint64) + np.uint64(1)
        return (mix(key) % np.uint64(self.shards)).astype(np.int64)

    def is_hot(self, key: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(key), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key


def _key(*context: np.ndarray) -> np.ndarray:
    out = np.full(len(context[0]), len(context), np.uint64)
    for c in context:
        out = mix(out * _K + c.view(np.uint64))
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum up word hashes within a task, pass them on when there are many."""
    keys, counts, size = [], [], 0

    def summed() -> pa.RecordBatch:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64))], ["key", "n"])

    base.forget()
    for _, values in base.pieces(batches):
        for part in ([values] if len(values) > 1 else ([s] for s in base.slices(values[0]))):
            key, n = np.unique(split(part, SPACED_LOWER).hashes.view(np.int64), return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
        keys.append(np.array([END_HASH]))
        counts.append(np.array([len(values)]))
        if size >= BUFFER:
            yield summed()
            keys, counts, size = [], [], 0
    if keys:
        yield summed()


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts of the training texts (doc_id, text): totals and the most frequent words."""
    unigrams = base.stored(docs.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "unigrams")
    steps = sorted({s << k for k in range(40) for s in (2, 3)} | {1})
    is_word = F.col("key") != END_HASH
    row = unigrams.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(~is_word, F.col("n"))), F.lit(0)), *(F.count_if(is_word & (F.col("n") >= s)) for s in steps)
    ).first()
    least = next((s for s, n in zip(steps, row[3:]) if n <= WORDS), steps[-1])
    found = unigrams.filter(is_word & (F.col("n") >= least)).toArrow()
    hashes, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by_count, by_hash = np.lexsort((hashes, -counts)), np.argsort(hashes)
    numbers = np.empty(len(hashes), np.int32)
    numbers[by_count] = np.arange(len(hashes))
    return Vocabulary(row[0], row[1], hashes[by_hash], numbers[by_hash], np.append(counts[by_count], row[2]), np.empty(0, np.uint64), np.empty(0, np.int64), least <= LEAST)


# -- bundles


_BUNDLE = (
    "bundle long, row array<long>, doc_id array<long>, held array<boolean>, ahead array<int>, size array<int>, codes binary, rare binary, tokens long, heavy array<struct<a:long,b:long,n:long>>"
)
_HEAVY = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unpacked(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Columns of the given types and lengths."""
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8) if blob else np.empty(0, np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _heavy(codes: np.ndarray, starts: np.ndarray, weight: np.ndarray, least: float) -> list[dict]:
    """Pairs with at least so many training tokens here."""
    u, inverse = np.unique(codes, return_inverse=True)
    often = np.bincount(inverse, weight, len(u)) >= least
    second = np.flatnonzero(often[inverse[1:]] & often[inverse[:-1]] & (weight[1:] > 0)) + 1
    second = second[~starts[second]]
    key, n = np.unique(inverse[second - 1] * len(u) + inverse[second], return_counts=True)
    return [{"a": int(u[k // len(u)]), "b": int(u[k % len(u)]), "n": int(c)} for k, c in zip(key[n >= least].tolist(), n[n >= least].tolist())]


def _bundler(shared, threshold: float):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = shared.value
        end, task = len(words.hashes), TaskContext.get().partitionId() << 32
        rows, parts, size, made, seen = [], [], 0, 0, 0
        tail = np.empty(0, np.int64)

        def emit() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            sizes, held = np.array([r[3] + r[4] for r in rows]), np.array([r[2] for r in rows])
            starts = np.zeros(len(codes), bool)
            starts[np.cumsum(sizes) - sizes] = True
            weight = np.repeat(~held, sizes).astype(np.int64)
            rare = np.unique(codes[codes < 0])
            short = np.where(codes < 0, -1 - np.searchsorted(rare, codes), codes).astype(np.int32)
            columns = [[task + made], *([list(c)] for c in zip(*rows)), [_packed(short)], [rare.tobytes()], [len(codes)], [_heavy(codes, starts, weight, threshold * len(codes))]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), _HEAVY)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _BUNDLE.split(", ")])

        base.forget()
        for batch in batches:
            held_out, at = batch.column(2).to_pylist(), 0
            for ids, values in base.pieces(iter([batch]), SLICE):
                slices = [[v] for v in base.slices(values[0], SLICE)] if len(values) == 1 else [values]
                for k, part in enumerate(slices):
                    found = split(part, SPACED_LOWER)
                    u, inverse = np.unique(found.hashes, return_inverse=True)
                    codes = words.codes(u)[inverse]
                    last = k == len(slices) - 1
                    for i in range(len(part)):
                        mine = codes[found.bounds[i] : found.bounds[i + 1]]
                        if last:
                            mine = np.append(mine, end)
                        before = tail if k else tail[:0]
                        if len(mine):
                            rows.append((task + seen, ids[i], held_out[at + i], len(before), len(mine)))
                            parts.append(np.concatenate([before, mine]))
                            size += len(mine) + len(before)
                            tail = parts[-1][-2:]
                        if last:
                            seen += 1
                    if size >= BUNDLE:
                        yield emit()
                        made += 1
                        rows, parts, size = [], [], 0
                at += len(ids)
        if rows:
            yield emit()

    return bundle


class Bundle:
    """A bundle's tokens and their distinct n-grams, in the order in which the shards are asked."""

    def __init__(self, words: Vocabulary, row: dict):
        self.words = words
        rare = np.frombuffer(row["rare"], np.int64)
        (short,) = _unpacked(row["codes"], (np.int32, row["tokens"]))
        self.codes = codes = short.astype(np.int64)
        codes[short < 0] = rare[-1 - codes[short < 0]]
        ahead, size = np.array(row["ahead"]), np.array(row["size"])
        whole = ahead + size
        first = np.cumsum(whole) - whole
        self.segment = np.repeat(np.arange(len(size)), whole)
        place = np.arange(len(codes)) - first[self.segment]
        self.scored = place >= ahead[self.segment]
        weight = np.repeat(~np.array(row["held"]), whole)
        #: for each order: tokens, the distinct n-gram of each, its columns, its training count, its context's number and key
        self.orders = []
        ones = np.flatnonzero(codes < 0)
        ones = ones[self.scored[ones]]
        for order in (1, 2, 3):
            at = ones if order == 1 else np.flatnonzero(self.scored & (place >= order - 1))
            if order == 2 and words.complete:
                # n-grams of other words can't be frequent enough; they count for their contexts alone
                codes = np.where(codes < 0, UNKNOWN, codes)
            if order < 3:
                u, local = np.unique(codes, return_inverse=True)
            if order > 1 and words.complete:
                for k in range(1, order):
                    at = at[codes[at - k] >= 0]
            key = local[at]
            for k in range(1, order):
                key = key | local[at - k] << (21 * k)
            key, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, weight[at], len(key)).astype(np.int64)
            columns = [u[(key >> (21 * k)) & ((1 << 21) - 1)] for k in range(order - 1, -1, -1)]
            context = _key(*columns[: max(1, order - 1)])
            shard = words.shard_of(context, columns[-1])
            turn = np.argsort(shard, kind="stable")
            back = np.empty(len(turn), np.int64)
            back[turn] = np.arange(len(turn))
            # in the order of the shards
            self.orders.append((at, back[inverse], [c[turn] for c in columns], n[turn], context[turn], np.searchsorted(shard[turn], np.arange(words.shards + 1))))

    def asks(self) -> Iterator[tuple[int, list[int], bytes]]:
        """(shard, numbers of asks by order, their columns)."""
        for shard in range(self.words.shards):
            sizes, columns = [], []
            for _, _, parts, n, _, cuts in self.orders:
                lo, hi = cuts[shard], cuts[shard + 1]
                sizes.append(int(hi - lo))
                columns += [np.diff(parts[0][lo:hi], prepend=0), *(p[lo:hi] for p in parts[1:]), n[lo:hi].astype(np.int32)]
            if any(sizes):
                yield shard, sizes, _packed(*columns)


def _asker(shared):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.forget()
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(shard, row["bundle"], sizes, blob) for shard, sizes, blob in Bundle(shared.value, row).asks()]
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "bundle", "sizes", "asks"])

    return ask


# -- shards


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10((count - DISCOUNT) / np.maximum(total, 1))


def _back(taken: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log10 of what discounting leaves of a context."""
    return np.log10(np.clip(1 - taken / np.maximum(total, 1), 1e-9, 1))


def _new(columns: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _level(words: Vocabulary, columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """From a level built of all asks: code of each ask's n-gram, code of its context's back-off, whether that is hot, the n-gram's count, sums of hot contexts.

    What a hot context gives to its n-grams is known only when the sums of its shards are put together.
    """
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    gram, context = _new(columns), _new(columns[:-1])
    first = np.flatnonzero(gram)
    count = np.add.reduceat(n[order], first)
    of_gram, of_context = np.cumsum(gram) - 1, np.cumsum(context) - 1
    owner, contexts = of_context[first], int(of_context[-1]) + 1
    total = np.bincount(owner, count, contexts)
    kept = np.flatnonzero((count >= LEAST) & (columns[-1][first] != UNKNOWN))
    taken = np.bincount(owner[kept], count[kept] - DISCOUNT, contexts)
    key = _key(*(c[np.flatnonzero(context)] for c in columns[:-1]))
    hot = words.is_hot(key)
    sums = [(int(k), int(t), float(d)) for k, t, d in zip(key[hot].view(np.int64), total[hot], taken[hot])]
    back = np.zeros(contexts)
    some = (total > 0) & ~hot
    back[some] = _back(taken[some], total[some])
    whole = total[owner]
    last = columns[-1][first]
    known, word = np.unique(last[kept], return_inverse=True)
    level = Level.of(owner[kept], word, contexts, max(1, len(known)), _share(count[kept], whole[kept]), back).mapped()
    at = np.minimum(np.searchsorted(known, last), max(0, len(known) - 1))
    code = level.find(owner, np.where(known[at] == last, at, -1)) if len(known) else np.full(len(first), ABSENT, np.uint16)
    out = []
    for values in (code[of_gram], level.back[of_context], hot[of_context], count[of_gram]):
        out.append(np.empty(len(order), values.dtype))
        out[-1][order] = values
    return *out, sums


def _contexts(columns: list[np.ndarray]) -> np.ndarray:
    """First asks of each context; asks of one context follow each other."""
    return np.flatnonzero(_new(columns[:-1]))


def _answerer(shared):
    def answer(table: pa.Table) -> pa.Table:
        words: Vocabulary = shared.value
        bundles, sizes, blobs = (table[c].to_pylist() for c in ("bundle", "sizes", "asks"))
        decoded = []
        for size, blob in zip(sizes, blobs):
            kinds = [(kind, s) for o, s in enumerate(size, 1) for kind in (*[np.int64] * o, np.int32)]
            found = _unpacked(blob, *kinds)
            decoded.append([[np.cumsum(found[0]), found[1]], [np.cumsum(found[2]), found[3], found[4]], [np.cumsum(found[5]), found[6], found[7], found[8]]])
        replies: list[list[np.ndarray]] = [[] for _ in bundles]
        sums: list[tuple[int, int, float]] = []
        for order in (1, 2, 3):
            columns = [np.concatenate([d[order - 1][k] for d in decoded]) for k in range(order + 1)]
            *columns, n = columns
            cuts = np.cumsum([0, *(s[order - 1] for s in sizes)])
            n = n.astype(np.int64)
            if not len(n):
                continue
            if order == 1:
                _, inverse = np.unique(columns[0], return_inverse=True)
                answers = np.bincount(inverse, n)[inverse].astype(np.int64)
                backs = None
            else:
                answers, backs, hot, counts, more = _level(words, columns, n)
                sums += more
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                replies[i].append(answers[lo:hi])
                if backs is not None and hi > lo:
                    replies[i] += [backs[lo:hi][_contexts([c[lo:hi] for c in columns])], counts[lo:hi][hot[lo:hi]]]
        shard = table["shard"][0].as_py()
        columns = [bundles, [shard] * len(bundles), [_packed(*r) for r in replies], [[] for _ in bundles]]
        columns[3][0] = [{"key": k, "total": t, "taken": d} for k, t, d in sums]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("total", pa.int64()), ("taken", pa.float64())])))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bundle", "shard", "answers", "hot"])

    return answer


# -- scores


class Scorer:
    """Adds up the probabilities of a bundle's tokens from the answers of the shards."""

    def __init__(self, words: Vocabulary, hot: list[tuple[int, int, float]]):
        self.words = words
        order = np.argsort(np.array([h[0] for h in hot], np.int64).view(np.uint64))
        self.keys = np.array([h[0] for h in hot], np.int64).view(np.uint64)[order]
        self.totals = np.array([h[1] for h in hot], np.int64)[order]
        self.backs = quantise(_back(np.array([h[2] for h in hot], float)[order], self.totals))

    def __call__(self, row: dict, answers: list[dict]) -> dict[str, np.ndarray]:
        words, bundle = self.words, Bundle(self.words, row)
        is_hot = [words.is_hot(o[4]) for o in bundle.orders[1:]]
        asked: list[list[np.ndarray]] = [[] for _ in range(7)]
        for a in sorted(answers, key=lambda a: a["shard"]):
            lohi = [(int(o[5][a["shard"]]), int(o[5][a["shard"] + 1])) for o in bundle.orders]
            kinds, spread = [(np.int64, lohi[0][1] - lohi[0][0])], []
            for (lo, hi), order, hot in zip(lohi[1:], bundle.orders[1:], is_hot):
                new = _new([c[lo:hi] for c in order[2][:-1]])
                spread.append(np.cumsum(new) - 1)
                kinds += [(np.uint16, hi - lo), (np.uint16, int(new.sum())), (np.int64, int(hot[lo:hi].sum()))]
            found = _unpacked(a["answers"], *kinds)
            found[2], found[5] = found[2][spread[0]], found[5][spread[1]]
            for into, part in zip(asked, found):
                into.append(part)
        rare, *parts = (np.concatenate(a) if a else np.empty(0, np.int64) for a in asked)
        counts = np.zeros(len(bundle.codes), np.int64)
        number = bundle.codes >= 0
        counts[number] = words.counts[bundle.codes[number]]
        at, inverse = bundle.orders[0][:2]
        counts[at] = rare[inverse]
        logs = words.log_base(counts)
        prob = 10**logs
        for (at, inverse, columns, _, key, _), hot, (codes, backs, known) in zip(bundle.orders[1:], is_hot, (parts[:3], parts[3:])):
            if not len(key):
                continue
            if hot.any():
                i = np.searchsorted(self.keys, key[hot])
                codes[hot] = np.where((known >= LEAST) & (columns[-1][hot] != UNKNOWN), quantise(_share(np.maximum(known, LEAST), self.totals[i])), ABSENT)
                backs[hot] = self.backs[i]
            prob[at] = _VALUES[codes][inverse] + _VALUES[backs][inverse] * prob[at]
        sums = lambda x: np.bincount(bundle.segment, np.where(bundle.scored, x, 0), len(row["size"]))
        return {"n_tokens": np.array(row["size"], np.int64), "n_known": sums(counts > 0).astype(np.int64), "base_score": sums(logs), "score": sums(np.minimum(np.log10(prob), 0))}


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                found = scorer(row, row["found"])
                columns = [pa.array(row["row"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array(row["held"]), *map(pa.array, found.values())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", *found])

    return score


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all texts by a model of those that aren't held out: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain.

    ``gain`` is what context adds to a token on average: the difference of the two scores by the number of tokens.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    source = base.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    words = vocabulary(source.filter("not held").select("doc_id", "text"))
    limit = max(HOT, HOT_SHARE * words.total)
    # a pair of so many tokens has half of them in bundles where it has at least half of its share
    bundles = base.stored(source.mapInArrow(_bundler(send(words), limit / 2 / max(1, words.total)), _BUNDLE), "bundles")
    tokens = bundles.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    words.shards = max(1, -(-tokens // SHARD))
    # at most 2 / HOT_SHARE rows
    heavy = bundles.select(F.explode("heavy").alias("h")).groupBy("h.a", "h.b").agg(F.sum("h.n").alias("n")).filter(F.col("n") >= limit / 2).collect()
    often = np.flatnonzero(words.counts >= limit)
    keys = np.concatenate([_key(often), _key(np.array([r[0] for r in heavy], np.int64), np.array([r[1] for r in heavy], np.int64))])
    sizes = np.concatenate([words.counts[often], [r[2] for r in heavy]])
    order = np.argsort(keys)
    words.hot, words.splits = keys[order], np.maximum(2, sizes[order] // limit + 1).astype(np.int64)
    model = send(words)
    asks = bundles.mapInArrow(_asker(model), "shard int, bundle long, sizes array<int>, asks binary")
    answers = asks.groupBy("shard").applyInArrow(_answerer(model), "bundle long, shard int, answers binary, hot array<struct<key:long,total:long,taken:double>>")
    answers = base.stored(answers, "answers")
    hot = answers.select(F.explode("hot").alias("h")).groupBy("h.key").agg(F.sum("h.total"), F.sum("h.taken")).collect()
    found = answers.groupBy("bundle").agg(F.collect_list(F.struct("shard", "answers")).alias("found"))
    rows = bundles.drop("heavy").join(found, "bundle", "left").withColumn("found", F.coalesce("found", F.array()))
    parts = rows.mapInArrow(
        _scorer(send(Scorer(words, [tuple(r) for r in hot]))), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    # a very long text is in parts
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs, base.crc_remainder("doc_id", HELD_OUT) == 0)
