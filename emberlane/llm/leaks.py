"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over every training window.

Text is lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window. The training side slides a window hash over each
text (one prefix sum per batch); hashes that may be in the set are verified word by word. Words inside any occurrence
are hit. Nothing is shuffled by text: each document is decided where it is read.

The set is broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text (a worker holds up to about 24 bytes for each
byte of it: words of one letter; 7 for usual words). A benchmark beyond one block is scanned block by block, each pass
adding to the hits that its rows carry, so that the number of blocks changes no result and no row meets another. Passes are
written in between and dropped when the next one is: a stage has one Python operator and one block in memory, on the driver
too, whatever the size of the benchmark, and the corpus is read once per block.

Null texts have no words. Repeated items and documents are rows like any other; a null item id counts as an item but
has no name to list. An empty benchmark hits nothing; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .words import ALNUM_LOWER, Runs, Words, split

WINDOW = 10
#: Most benchmark text that is broadcast at once.
BLOCK_BYTES = 8 << 20
_BITS = 22
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "doc_id long, text string, n_words long, hit_runs array<struct<start:long,end:long>>, items array<string>"


class GramSet:
    """The windows of a block of benchmark items: sorted hashes for the scan, places in the items' words for the check."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.items = [item for item, _ in items]
        self.words = words = split([b" ".join(split([text], ALNUM_LOWER, False).plain()) for _, text in items], ALNUM_LOWER)
        counts = np.diff(words.bounds)
        runs = Runs(words.hashes)
        self.hashes: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray] = {}
        self.filters: dict[int, np.ndarray] = {}
        sizes = np.minimum(counts, window)
        for size in np.unique(sizes[sizes > 0]).tolist():
            starts = np.concatenate([np.arange(words.bounds[i], words.bounds[i + 1] - size + 1) for i in np.flatnonzero(sizes == size)])
            found = runs.of(starts, starts + size)
            order = np.argsort(found, kind="stable")
            self.hashes[size], self.places[size] = found[order], starts[order].astype(np.int32)
            self.filters[size] = np.zeros(1 << _BITS, bool)
            self.filters[size][(found >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def owners(self, size: int, hashed: int, gram: bytes) -> set[int]:
        """Numbers of the items that have this window, by its words."""
        known, places, mine = self.hashes[size], self.places[size], self.words
        lo, hi = np.searchsorted(known, hashed, "left"), np.searchsorted(known, hashed, "right")
        same = [p for p in places[lo:hi].tolist() if mine.data[mine.start[p] : mine.end[p + size - 1]] == gram]
        return set((np.searchsorted(mine.bounds, same, "right") - 1).tolist())

    def scan(self, words: Words) -> list[tuple[int, int, set[int]]]:
        """(first word, last word + 1, numbers of items) of each verified occurrence that lies within one text."""
        runs, found = Runs(words.hashes), []
        text_end = np.repeat(words.bounds[1:], np.diff(words.bounds))
        seen: dict[tuple[int, bytes], set[int]] = {}
        for size, known in self.hashes.items():
            starts = np.arange(max(0, len(words.start) - size + 1))
            h = runs.of(starts, starts + size)
            maybe = np.flatnonzero(self.filters[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            maybe = maybe[maybe + size <= text_end[maybe]]
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            for s in maybe[known[at] == h[maybe]].tolist():
                key = (size, _gram(words, s, s + size))
                if key not in seen:
                    seen[key] = self.owners(size, h[s], key[1])
                if seen[key]:
                    found.append((s, s + size, seen[key]))
        return found


def _gram(words: Words, start: int, end: int) -> bytes:
    return b" ".join(words.word(i) for i in range(start, end))


def _merge(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.forget()
        grams: GramSet = shared.value
        names = grams.items
        for batch in batches:
            runs_before, items_before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            counts, runs, items = [], [], []
            for ids, values in base.pieces(iter([batch])):
                words = split(values, ALNUM_LOWER)
                hits: dict[int, list] = {}
                for start, end, owners in grams.scan(words):
                    hits.setdefault(int(np.searchsorted(words.bounds, start, "right")) - 1, []).append((start, end, owners))
                lengths = np.diff(words.bounds).tolist()
                for i in range(len(ids)):
                    mine, first, row = hits.get(i, []), int(words.bounds[i]), len(counts)
                    counts.append(lengths[i])
                    before = [(r["start"], r["end"]) for r in runs_before[row]]
                    runs.append(_merge(before + [(s - first, e - first) for s, e, _ in mine]))
                    found = set(items_before[row]).union(names[o] for _, _, owners in mine for o in owners)
                    items.append(sorted(found, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "hit_runs", "items"],
            )

    return scan


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in blocks of at most ``BLOCK_BYTES``, one at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        value = (row[1] or "").encode()
        if block and size + len(value) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], value))
        size += len(value) + 64
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its text and number of words, the merged hit runs of words, and the items found (sorted strings)."""
    out = base.texts(docs).select(
        F.col("doc_id").cast("long"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("hit_runs"),
        F.array().cast("array<string>").alias("items"),
    )
    spark, shared, path = docs.sparkSession, None, None
    for block in _blocks(benchmark):
        if shared is not None:
            before, path = path, base.written(out, "hits")
            out = spark.read.schema(out.schema).parquet(path)
            shared.destroy()
            if before:
                base.remove(spark, before)
        shared = spark.sparkContext.broadcast(GramSet(block, window))
        out = out.mapInArrow(_scanner(shared), _HITS)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(hit_runs, 0L, (s, r) -> s + r.end - r.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns; rows that repeat an id are judged by their own texts."""
    bad = hits(docs, benchmark).filter(F.size("items") > 0).select("doc_id", F.xxhash64("text").alias("content"))
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["content"])
    return docs.join(bad, same, "left_anti")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value, runs in zip(base.as_bytes(batch.column(1)), batch.column(3).to_pylist()):
            if value is None or not runs:
                out.append(None if value is None else value.decode())
                continue
            words = split([value], ALNUM_LOWER, False)
            kept, at = [], 0
            for run in runs:
                kept.append(value[at : words.start[run["start"]]])
                at = int(words.end[run["end"] - 1])
            out.append((b"".join(kept) + value[at:]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text without the bytes from the first to the last word of each hit run; null stays null.

    The hits of all blocks are found in the input first and cut once.
    """
    return hits(docs, benchmark).mapInArrow(_cut, "doc_id long, text string")
