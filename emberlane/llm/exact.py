"""Exact deduplication against history: a minimal perfect hash over the distinct digests of the past.

Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Each text becomes a SHA-256 digest.
History is reduced to one row per digest (largest id, number of copies) before anything is shuffled by digest, so a group
that holds a third of all rows is one row per task. The distinct digests are dealt into small shards by their own bits;
each shard becomes one blob: levels of bit sets (every key sets a bit that no other key of its level sets) whose ranks
number the keys without gaps, and a slot for each number with the full digest and the winner. New digests, reduced in the
same way, are looked up in their shard and believed only when the slot's 32 bytes are equal; digests outside history form
groups of their own.

Empty tables give empty results. Repeated ids are rows like any other: each row counts as one copy.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .words import mix

#: Distinct digests per shard, on average.
SHARD_KEYS = 1024
_GAMMA = 2.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A column of our own beside those of the documents.
_MARK = "__text_digest"
_DIGESTS = "doc_id long, digest binary"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base.forget()
    for batch in batches:
        digests = [hashlib.sha256((t or b"").lower()).digest() for t in base.as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each normalised text."""
    return base.texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest_rows, _DIGESTS)


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows (summed before the shuffle)."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("copies"))


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    return raw[:, 1].copy(), raw[:, 2].copy()


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers n distinct digests 0..n-1; any other digest gets some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        seen = 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + seen)
            seen += int(bits.sum())

    @classmethod
    def of(cls, digests: list[bytes]) -> PerfectHash:
        a, b = _words(digests)
        levels: list[np.ndarray] = []
        while len(a):
            size = max(2, math.ceil(_GAMMA * len(a)))
            place = _place(a, b, len(levels), size)
            bits = np.bincount(place, minlength=size) == 1
            levels.append(bits)
            left = ~bits[place]
            a, b = a[left], b[left]
            if len(levels) > 200:
                raise ValueError("digests are not distinct")
        return cls(levels)

    def numbers(self, digests: list[bytes]) -> np.ndarray:
        a, b = _words(digests)
        found = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = _place(a[left], b[left], level, len(bits))
            hit = bits[place]
            found[left[hit]] = self.ranks[level][place[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<u4", n, 4), 4 + 4 * n, []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


def _build(table: pa.Table) -> pa.Table:
    digests = table["digest"].to_pylist()
    hashed = PerfectHash.of(digests)
    order = np.argsort(hashed.numbers(digests))
    slots = b"".join(digests[i] for i in order)
    winners = np.asarray(table["winner"])[order].astype("<i8").tobytes()
    copies = np.asarray(table["copies"])[order].astype("<i8").tobytes()
    return pa.table(
        {
            "shard": pa.array(table["shard"].to_pylist()[:1], pa.int32()),
            "hash": pa.array([hashed.to_bytes()], pa.binary()),
            "slots": pa.array([slots], pa.binary()),
            "winners": pa.array([winners], pa.binary()),
            "copies": pa.array([copies], pa.binary()),
        }
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """History's groups (digest, winner, copies) as one row of blobs per shard."""
    return (
        history.withColumn("shard", _shard(shards))
        .groupBy("shard")
        .applyInArrow(_build, "shard int, hash binary, slots binary, winners binary, copies binary")
    )


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    found = new["digest"].to_pylist()
    size = len(found)
    winner, copies = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    member = np.zeros(size, bool)
    if index.num_rows and size:
        slots = index["slots"][0].as_py()
        number = PerfectHash.from_bytes(index["hash"][0].as_py()).numbers(found)
        member = np.array([n >= 0 and slots[32 * n : 32 * n + 32] == d for n, d in zip(number.tolist(), found)], bool)
        at = number[member]
        winner[member] = np.frombuffer(index["winners"][0].as_py(), "<i8")[at]
        copies[member] = np.frombuffer(index["copies"][0].as_py(), "<i8")[at]
    return pa.table(
        {
            "digest": pa.array(found, pa.binary()),
            "member": pa.array(member),
            "past_winner": pa.array(winner, mask=~member),
            "past_copies": pa.array(copies),
            "winner": new["winner"],
            "copies": new["copies"],
        }
    )


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """New groups with ``member`` (true when the digest is in history), history's winner and its copies."""
    return (
        index.groupBy("shard")
        .cogroup(new.withColumn("shard", _shard(shards)).groupBy("shard"))
        .applyInArrow(_look_up, "digest binary, member boolean, past_winner long, past_copies long, winner long, copies long")
    )


def shard_count(rows: int) -> int:
    return max(1, math.ceil(rows / SHARD_KEYS))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests of all rows, one row per distinct digest with keep_id and group_size).

    The earlier half of the id range is history and the later half is checked against it; which half a row falls in
    changes nothing in the result.
    """
    rows = base.stored(digests(docs), "digests")
    size, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    pivot = 0 if low is None else low + (high - low) // 2
    shards = shard_count(size)
    is_past = F.coalesce(F.col("doc_id"), F.lit(pivot)) <= pivot
    past = groups(rows.filter(is_past))
    found = base.stored(look_up(groups(rows.filter(~is_past)), build_index(past, shards), shards), "found")
    merged = found.filter("member").select(
        "digest", F.greatest("past_winner", "winner").alias("keep_id"), (F.col("past_copies") + F.col("copies")).alias("group_size")
    )
    fresh = found.filter("not member").select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"))
    untouched = past.join(found.filter("member").select("digest"), "digest", "left_anti").select(
        "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size")
    )
    return rows, merged.unionByName(fresh).unionByName(untouched)


def report(docs: DataFrame) -> DataFrame:
    """Every row with the id that stays for its text, the size of its group and its digest."""
    rows, found = classes(docs)
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows whose id stays for their text, with all their columns; of rows that repeat id and text one stays.

    A text that has null ids only keeps one row as well.
    """
    rows, found = classes(docs)
    found = base.stored(found.select("keep_id", "digest"), "winners")
    is_winner = lambda id_, digest: F.col(id_).eqNullSafe(F.col("keep_id")) & (digest == F.col("win"))
    wins = found.withColumnRenamed("digest", "win")
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    kept = docs.join(wins, is_winner("doc_id", F.unhex(F.sha2(lower, 256))), "left_semi")
    if rows.join(wins, is_winner("doc_id", F.col("digest")), "left_semi").count() == found.count():
        return kept
    # a winner's row is there more than once
    marked = kept.withColumn(_MARK, F.sha2(lower, 256))
    return marked.dropDuplicates(["doc_id", _MARK]).drop(_MARK)
