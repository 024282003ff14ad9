"""Importance resampling towards a target distribution over hashed n-gram buckets.

Features are runs of one to three consecutive words, each in one of ``BUCKETS`` buckets. A bucket's gain is the scaled log
ratio of its smoothed shares in the target and in the source; a document's weight is the sum of the gains of its features.
Gumbel noise from a hash of the id added to the weights makes the highest scores a draw without replacement.

Inside a task, the n-grams of a batch of texts are interned in an open-addressed NumPy table: keys are 64-bit xxHash of the
n-gram's bytes, probing is linear, and a slot is shared only after its bytes have been compared. A slot holds the n-gram's
bucket, computed once, and its count; every occurrence knows its slot. The first pass adds the counts of slots to buckets
(at most ``BUCKETS`` rows leave a task), the second gathers the gains of slots by occurrence and sums them by document.
Neither shuffles text. Ranks come from a range partitioning of (score, doc_id) alone.

Null and empty texts have no words, weight 0 and no rank. Texts longer than a piece go through in slices that carry two
words over. Rows that repeat a doc_id stand for themselves (equal scores in any order); a null id has the noise of an empty
one and comes last among equals. An empty target has no features, an empty table gives no rows. Only the id and the text are
read, whatever other columns there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from . import base
from .words import ALNUM_LOWER

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SCALE = 1000
SEED = 42
#: Most bytes of text whose n-grams are interned at once.
PIECE = 1 << 18

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
#: Inputs of a full stripe or more go to the library one by one.
_STRIPE = 32
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _crc_tables() -> np.ndarray:
    """table[k][w]: what the two bytes of w followed by 6 - 2k zero bytes give, without start and end values."""
    raw = lambda data: zlib.crc32(data) ^ zlib.crc32(bytes(len(data)))
    one = np.array([[raw(bytes([b]) + bytes(k)) for b in range(256)] for k in range(8)], np.uint32)
    w = np.arange(1 << 16)
    return np.stack([one[7 - 2 * k][w & 255] ^ one[6 - 2 * k][w >> 8] for k in range(4)])


_CRC = _crc_tables()
#: Bits that put the low n of eight bytes behind zero bytes.
_FILL = np.array([8 * (8 - n) if n else 0 for n in range(9)], np.uint64)


def _crc_of(lane: np.ndarray) -> np.ndarray:
    parts = lane.view(np.uint16).reshape(-1, 4)
    found = np.take(_CRC[0], parts[:, 0])
    for k in range(1, 4):
        found ^= np.take(_CRC[k], parts[:, k])
    return found


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class Grams:
    """Byte ranges of n-grams in one buffer."""

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        buf = np.frombuffer(data + bytes(8), np.uint8)
        # the eight bytes from each place of the buffer
        self.eights = np.ascontiguousarray(np.lib.stride_tricks.as_strided(buf, (len(data) + 1, 8), (1, 1))).view(np.uint64)[:, 0]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]]

    def keys(self) -> np.ndarray:
        """xxHash64 with seed 0 of every range."""
        start, size = self.start, self.size
        out = size.astype(np.uint64) + _P5
        for lane in range(_STRIPE // 8 - 1):
            rows = np.flatnonzero(size >= 8 * lane + 8)
            if not len(rows):
                break
            k = _rotl(self.eights[start[rows] + 8 * lane] * _P2, 31) * _P1
            out[rows] = _rotl(out[rows] ^ k, 27) * _P1 + _P4
        at, left = start + (size & ~7), size & 7
        rows = np.flatnonzero(left >= 4)
        k = (self.eights[at[rows]] & np.uint64(0xFFFFFFFF)) * _P1
        out[rows] = _rotl(out[rows] ^ k, 23) * _P2 + _P3
        at[rows] += 4
        left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left > 0)
            k = (self.eights[at[rows]] & np.uint64(0xFF)) * _P5
            out[rows] = _rotl(out[rows] ^ k, 11) * _P1
            at[rows] += 1
            left[rows] -= 1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        out ^= out >> np.uint64(32)
        for i in np.flatnonzero(size >= _STRIPE).tolist():
            out[i] = xxhash.xxh64_intdigest(self.bytes_of(i))
        return out

    def crc32(self, of: np.ndarray) -> np.ndarray:
        """CRC-32 of the ranges ``of``, eight bytes at a time.

        Without its start and end values a CRC is linear and zero bytes in front change nothing, so a range is read as if
        zeros filled its first eight bytes up; the CRC of as many zero bytes then adds what the start and end values do.
        """
        start, size = self.start[of], self.size[of]
        lanes = (size + 7) >> 3
        head = size - 8 * (lanes - 1)
        lane = (self.eights[start] & _LOW[head]) << _FILL[head]
        out, rows, at = _crc_of(lane), np.flatnonzero(lanes > 1), start + head
        while len(rows):
            found = _crc_of(self.eights[at[rows]] ^ out[rows])
            out[rows] = found
            at[rows] += 8
            lanes[rows] -= 1
            rows = rows[lanes[rows] > 1]
        longest = int(size.max(initial=0))
        if longest < _STRIPE * 8:
            return out ^ np.array([zlib.crc32(bytes(n)) for n in range(longest + 1)], np.uint32)[size]
        sizes, which = np.unique(size, return_inverse=True)
        return out ^ np.array([zlib.crc32(bytes(n)) for n in sizes.tolist()], np.uint32)[which]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ranges a[i] and b[i] hold the same bytes."""
        same = self.size[a] == self.size[b]
        rows, at = np.flatnonzero(same), 0
        while len(rows):
            x, y = a[rows], b[rows]
            apart = (self.eights[self.start[x] + at] ^ self.eights[self.start[y] + at]) & _LOW[np.minimum(self.size[x] - at, 8)]
            same[rows[apart != 0]] = False
            at += 8
            rows = rows[(apart == 0) & (self.size[x] > at)]
        return same


class Table:
    """An open-addressed table of the distinct n-grams of a batch: key, first occurrence, bucket and count per slot."""

    def __init__(self, grams: Grams, keys: np.ndarray | None = None):
        keys = grams.keys() if keys is None else keys
        n = len(keys)
        size = 1 << max(4, (2 * n - 1).bit_length())
        mask = np.uint64(size - 1)
        self.key, self.owner = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.slot_of = at = (keys & mask).astype(np.int32)
        left, wanted = np.arange(n, dtype=np.int32), keys
        while len(left):
            # all occurrences of an n-gram probe the same slot in the same round; of those that find it free the last one owns it
            free = np.flatnonzero(self.owner[at] < 0)
            slots = at[free]
            self.owner[slots] = left[free]
            self.key[slots] = wanted[free]
            owner = self.owner[at]
            maybe = np.flatnonzero((self.key[at] == wanted) & (owner != left))
            other = (self.key[at] != wanted) | (owner < 0)
            other[maybe[~grams.equal(owner[maybe], left[maybe])]] = True
            rest = np.flatnonzero(other)
            left, wanted = left[rest], wanted[rest]
            at = (at[rest] + 1) & np.int32(size - 1)
            self.slot_of[left] = at
        self.used = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot_of, minlength=size)
        self.bucket = np.zeros(size, np.int32)
        self.bucket[self.used] = grams.crc32(self.owner[self.used]) % np.uint32(BUCKETS)

    def bucket_counts(self) -> np.ndarray:
        return np.bincount(self.bucket[self.used], weights=self.count[self.used], minlength=BUCKETS).astype(np.int64)


def _segments(values: list[bytes | None], piece: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Lists of about ``piece`` bytes of (row, words joined by one space, words carried over from the slice before)."""
    out, size = [], 0
    for row, value in enumerate(values):
        carry: list[bytes] = []
        for part in base.slices((value or b"").translate(ALNUM_LOWER), piece):
            words = part.split()
            out.append((row, b" ".join(carry + words), len(carry)))
            carry = (carry + words)[-(ORDER - 1) :]
            size += len(part)
            if size >= piece:
                yield out
                out, size = [], 0
    if out:
        yield out


def occurrences(segments: list[tuple[int, bytes, int]]) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The n-grams of some segments, the segment of each, and the new words of each segment."""
    data = b" ".join(text for _, text, _ in segments if text)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins, ends = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    carried = np.array([c for _, _, c in segments], np.int64)
    counts = np.array([text.count(b" ") + 1 if text else 0 for _, text, _ in segments], np.int64)
    if not data:
        begins, ends = begins[:0], ends[:0]
    segment = np.repeat(np.arange(len(segments)), counts)
    # a word's place in its segment, from the first one that isn't carried over
    place = np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts + carried, counts)
    start, size, owner = [], [], []
    for n in range(1, ORDER + 1):
        last = np.arange(n - 1, len(begins))
        head = last - (n - 1)
        ok = (segment[last] == segment[head]) & (place[last] >= 0)
        last, head = last[ok], head[ok]
        start.append(begins[head])
        size.append(ends[last] - begins[head])
        owner.append(segment[last])
    return Grams(data, np.concatenate(start), np.concatenate(size)), np.concatenate(owner), counts - carried


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for segments in _segments(base.as_bytes(batch.column(0)), PIECE):
            grams, _, _ = occurrences(segments)
            total += Table(grams).bucket_counts()
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over all texts of a one-column table."""
    counted = texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weigher(shared):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)  # whole numbers, sums stay far below 2**53
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for segments in _segments(base.as_bytes(batch.column(1)), PIECE):
                grams, owner, new_words = occurrences(segments)
                table = Table(grams)
                per_slot = gain[table.bucket]
                row = np.array([r for r, _, _ in segments], np.int64)
                n = len(segments)
                np.add.at(words, row, new_words)
                np.add.at(features, row, np.bincount(owner, minlength=n))
                np.add.at(weight, row, np.bincount(owner, weights=per_slot[table.slot_of], minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def scores(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """Every row's doc_id, words, features, weight and score; ``text`` names the target's column."""
    rows = base.texts(docs).select(F.col("doc_id").cast("long"), "text")
    gain = gains(bucket_counts(rows.select("text")), bucket_counts(target.select(F.col(text).cast("string").alias("text"))))
    weighed = rows.mapInArrow(_weigher(docs.sparkSession.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with the rank of the drawn rows: ``percent`` of those with at least ``min_words`` words, rounded down."""
    rows = base.stored(scores(docs, target), "scores").withColumn("_short", F.col("n_words") < min_words)
    drawn = rows.filter(~F.col("_short")).count() * percent // 100
    placed = numbered(rows, F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="_rank")
    return placed.withColumn("rank", F.when(~F.col("_short") & (F.col("_rank") < drawn), (F.col("_rank") + 1).cast("long"))).drop("_short", "_rank")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
