"""Substring deduplication with a compressed FM-index per shard.

A window of 50 words is removed where its words also start in a document with a smaller id. Documents are cut into
segments by content: every window is assigned to the smallest 8-word hash inside it (its anchor), and the run of
windows with one anchor is a segment. Equal windows have equal anchors, so segments with different anchors never need
to meet, and one that no other document shares is done. Segments of equal content are one from then on, known by their
smallest document: in every other document they go whole, however many copies there are.

Anchors with several contents are dealt into shards. A shard's segments become a word sequence with a suffix order, its
Burrows-Wheeler transform in a wavelet matrix of packed bits, and the smallest document of each range of suffixes that
begin with the same 50 words. The shard's documents are streamed through it: a backward search over the wavelet matrix
gives, for each place, how far the index matches it, and places that match 50 words or more report the smallest document
of their range. An anchor with more than ``HOT_CONTENTS`` contents (a passage that very many documents share) is too much
for one shard: its window hashes are dealt into parts that grow in number with the contents, and a part keeps the
smallest document of each window.

Words are runs of characters other than white space, unchanged, compared by 64-bit hashes. Null texts and texts without
words have no words and the digest of the empty string; shorter texts than a window lose nothing. A row that repeats an id
is not a smaller document for its twin. An empty table gives no rows; only the id and the text are read, whatever other columns
there are.
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
from .words import SPACED, Runs, run_starts, split

WINDOW = 50
GRAM = 8
HOT_CONTENTS = 512
SHARD_WORDS = 200_000
#: Document ids that may be broadcast to leave out texts before the shuffle (8 bytes each); beyond, all texts are shuffled.
BROADCAST_IDS = 1_000_000


# -- the index


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their first ``depth`` or more symbols, class of the first ``WINDOW`` symbols by position)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, h = {1: rank}, 1
    while h < depth:
        behind = np.full(n, -1, np.int64)
        behind[: n - h] = rank[h:] if h < n else behind[: n - h]
        rank = np.unique(rank * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
        h *= 2
        ranks[h] = rank
    half = 1 << (WINDOW.bit_length() - 1)
    late = np.full(n, -1, np.int64)
    late[: max(0, n - (WINDOW - half))] = ranks[half][WINDOW - half :]
    return np.argsort(rank, kind="stable"), ranks[half] * (n + 1) + late + 1


class WaveletMatrix:
    """Occurrences of symbols before a position, from packed bits and a count for each 64 of them."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.size = len(symbols)
        self.levels, current = [], symbols.astype(np.int64)
        for bit in range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[: self.size] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.uint32)
            self.levels.append((bit, words, counts, int(self.size - ones.sum())))
            current = np.concatenate([current[ones == 0], current[ones == 1]])
        self.first = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.levels:
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = counts[word].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Segments of words, each with a document id, searchable backwards."""

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray):
        lengths = np.array([len(s) for s in segments])
        joined = np.concatenate(segments)
        self.alphabet, inverse = np.unique(joined, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(joined) + len(segments), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = inverse + 1
        owner = np.repeat(np.arange(len(segments)), lengths + 1)
        order, window = suffix_order(text, 128)
        self.bits = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        # windows that run over a segment's end contain a separator and are never asked for
        sorted_window = window[order]
        first = np.concatenate([[True], sorted_window[1:] != sorted_window[:-1]])
        group = np.cumsum(first) - 1
        lowest = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(first))
        self.lowest = lowest[group]
        self.size = len(text)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, 0 for words that the index doesn't have."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def lowest_documents(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and each of its windows: the smallest document whose segments hold it, or the largest integer."""
        none = np.iinfo(np.int64).max
        lengths = np.array([len(q) for q in queries])
        out = [np.full(max(0, n - WINDOW + 1), none, np.int64) for n in lengths.tolist()]
        offset = np.cumsum(lengths) - lengths
        text = self.symbols(np.concatenate(queries)) if len(queries) else np.empty(0, np.int64)
        result_offset = np.cumsum(np.maximum(0, lengths - WINDOW + 1)) - np.maximum(0, lengths - WINDOW + 1)
        flat = np.concatenate(out) if out else np.empty(0, np.int64)
        live = np.flatnonzero(lengths >= WINDOW)
        # a cursor: the match [at, end) of its query, as a range of suffixes
        end, at = lengths[live].copy(), lengths[live].copy()
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        while len(live):
            symbol = text[offset[live] + at - 1]
            new_lo = self.start[symbol] + self.bits.before(symbol, lo)
            new_hi = self.start[symbol] + self.bits.before(symbol, hi)
            ok = (symbol > 0) & (new_lo < new_hi)
            at = np.where(ok, at - 1, at)
            lo, hi = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi)
            report = ok & (end - at >= WINDOW)
            flat[result_offset[live[report]] + at[report]] = self.lowest[lo[report]]
            # the word before the match can't be added: the next window to look for ends before the match does
            failed = ~ok
            end = np.where(failed, np.where(end - at >= WINDOW, at + WINDOW - 1, end - 1), end)
            at = np.where(failed, end, at)
            lo, hi = np.where(failed, 0, lo), np.where(failed, self.size, hi)
            going = (at > 0) & (end >= WINDOW)
            live, end, at, lo, hi = live[going], end[going], at[going], lo[going], hi[going]
        cuts = result_offset[1:]
        return np.split(flat, cuts) if len(queries) else []


# -- passes over the texts


_SEGMENT = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
_DESCRIBED = "doc_id long, text_key long, n_words long, sha256 string, segments array<struct<anchor:long,content:long,start:int,windows:int>>"


def _anchors(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window start, the leftmost smallest 8-word hash inside the window."""
    best, width = np.arange(len(grams)), 1
    span = WINDOW - GRAM + 1
    while width * 2 <= span:
        right = np.minimum(np.arange(len(grams)) + width, len(grams) - 1)
        other = best[right]
        best = np.where(grams[best] <= grams[other], best, other)
        width *= 2
    left, right = best[starts], best[starts + span - width]
    return np.where(grams[left] <= grams[right], left, right)


def segments_of(bounds: np.ndarray, runs: Runs, n: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, content hash, first window, windows) of every segment."""
    starts, text = run_starts(bounds, WINDOW)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    grams = runs.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    anchor = _anchors(grams, starts)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    content = runs.of(begin, begin + windows + WINDOW - 1)
    return text[first], grams[anchor[first]].view(np.int64), content.view(np.int64), begin - bounds[text[first]], windows


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, values in base.pieces(batches):
        words = split(values, SPACED)
        runs, n = Runs(words.hashes), len(words.start)
        text, anchor, content, start, windows = segments_of(words.bounds, runs, n)
        offsets = np.searchsorted(text, np.arange(len(values) + 1)).astype(np.int32)
        nested = pa.StructArray.from_arrays(
            [pa.array(anchor), pa.array(content), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], fields=list(_SEGMENT)
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(runs.of(words.bounds[:-1], words.bounds[1:]).view(np.int64)),
                pa.array(np.diff(words.bounds)),
                pa.array([hashlib.sha256(b" ".join(v.split())).hexdigest() for v in values]),
                pa.ListArray.from_arrays(pa.array(offsets), nested),
            ],
            ["doc_id", "text_key", "n_words", "sha256", "segments"],
        )


def _rows_with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, list of segment structs) one by one."""
    for batch in batches:
        for doc, value, found in zip(batch.column(0).to_pylist(), base.as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            yield doc, value or b"", found


def _key(words, runs: Runs) -> int:
    return int(runs.of(words.bounds[:1], words.bounds[1:2]).view(np.int64)[0])


def _fetch_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment, for the shards."""
    for doc, value, found in _rows_with_text(batches):
        words = split([value], SPACED)
        key = _key(words, Runs(words.hashes))
        mine = [s for s in found if s["text_key"] == key]
        if mine:
            blobs = [words.hashes[s["start"] : s["start"] + s["windows"] + WINDOW - 1].tobytes() for s in mine]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s["anchor"] for s in mine], pa.int64()),
                    pa.array([s["content"] for s in mine], pa.int64()),
                    pa.array([doc] * len(mine), pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                ["anchor", "content", "doc_id", "words"],
            )


def _fetch_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes of the wanted segments, packed by the part of the anchor that each hash falls into."""
    for doc, value, found in _rows_with_text(batches):
        words = split([value], SPACED)
        runs = Runs(words.hashes)
        key, rows = _key(words, runs), []
        for s in found:
            if s["text_key"] == key:
                at = np.arange(s["start"], s["start"] + s["windows"])
                window = runs.of(at, at + WINDOW)
                part = ((window >> np.uint64(32)) % np.uint64(s["parts"])).astype(np.int64)
                for k in np.unique(part).tolist():
                    mine = np.flatnonzero(part == k)
                    rows.append((s["anchor"], k, s["content"], doc, mine.astype("<i4").tobytes(), window[mine].tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "part", "content", "doc_id", "places", "windows"])


def _lowest_windows(table: pa.Table) -> pa.Table:
    """Windows of one part of an anchor that a smaller document has."""
    places, windows = table["places"].to_pylist(), table["windows"].to_pylist()
    sizes = np.array([len(p) // 4 for p in places])
    docs = np.repeat(np.asarray(table["doc_id"]), sizes)
    place, window = np.frombuffer(b"".join(places), "<i4"), np.frombuffer(b"".join(windows), np.uint64)
    _, group = np.unique(window, return_inverse=True)
    lowest = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, docs)
    hit = lowest[group] < docs
    return _hits(table, [place[a:b][hit[a:b]] for a, b in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist())])


def _hits(table: pa.Table, found: list[np.ndarray]) -> pa.Table:
    """One row for each segment that has hits."""
    some = [i for i, f in enumerate(found) if len(f)]
    anchors, contents = table["anchor"].to_pylist(), table["content"].to_pylist()
    return pa.table(
        {
            "anchor": pa.array([anchors[i] for i in some], pa.int64()),
            "content": pa.array([contents[i] for i in some], pa.int64()),
            "hits": pa.array([found[i].tolist() for i in some], pa.list_(pa.int32())),
        }
    )


_HITS = "anchor long, content long, hits array<int>"


def _search_shard(table: pa.Table) -> pa.Table:
    """Windows of a shard's segments that a smaller document has."""
    docs = np.asarray(table["doc_id"])
    segments = [np.frombuffer(b, np.uint64) for b in table["words"].to_pylist()]
    lowest = FMIndex(segments, docs).lowest_documents(segments)
    return _hits(table, [np.flatnonzero(low < doc) for low, doc in zip(lowest, docs)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed, digest and text of what stays of the texts with removed windows."""
    for doc, value, ranges in _rows_with_text(batches):
        words = split([value], SPACED)
        key = _key(words, Runs(words.hashes))
        change = np.zeros(len(words.start) + 1, np.int64)
        for r in ranges:
            if r["text_key"] == key:
                for first, last in [(0, r["windows"] - 1)] if r["hits"] is None else [(h, h) for h in r["hits"]]:
                    change[r["start"] + first] += 1
                    change[r["start"] + last + WINDOW] -= 1
        gone = np.cumsum(change[:-1]) > 0
        kept = b" ".join(w for w, g in zip(value.split(), gone.tolist()) if not g)
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc], pa.int64()), pa.array([key], pa.int64()), pa.array([int(gone.sum())], pa.int64()), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept.decode("utf-8", "surrogatepass")])],
            ["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text"],
        )


class Dedup:
    def __init__(self, docs: DataFrame):
        self.source = base.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.described = base.stored(self.source.mapInArrow(_describe, _DESCRIBED), "segments")

    def _with_text(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, text, list) for rows (doc_id, list), by a shuffle join of the texts that are wanted."""
        wanted = base.stored(wanted, "wanted")
        texts = self.source
        if wanted.count() <= BROADCAST_IDS:
            texts = texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
        return texts.join(wanted, "doc_id").select("doc_id", "text", "list")

    def removed(self) -> DataFrame:
        """(doc_id, text_key, start, windows, hits): segments with removed windows; hits are null where all of them go."""
        rows = self.described.select("doc_id", "text_key", F.explode("segments").alias("s")).select("doc_id", "text_key", "s.*")
        met = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
        # stored, so that both sides of the join are plain shuffles and a hot anchor can be split
        met = base.stored(met, "met")
        shared = base.stored(rows.join(met, "anchor", "left_semi"), "shared")
        # one row per content: its smallest document, and one place of it there
        contents = shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("head"))
        contents = base.stored(contents.select("anchor", "content", F.col("head.doc_id").alias("head_id"), "head.text_key", "head.start", "head.windows"), "contents")
        several = contents.groupBy("anchor").agg(F.count("*").alias("n_contents")).filter("n_contents > 1")
        several = base.stored(several, "several")
        parts = F.ceil(F.col("n_contents") / HOT_CONTENTS).cast("int")
        open_contents = base.stored(contents.join(several, "anchor").withColumn("parts", parts), "open")
        found = self._by_shard(open_contents.filter("parts = 1")).unionByName(self._by_window(open_contents.filter("parts > 1")))
        found = base.stored(found.groupBy("anchor", "content").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")), "found")
        placed = shared.join(contents.select("anchor", "content", "head_id"), ["anchor", "content"])
        whole = placed.filter("doc_id > head_id").select("doc_id", "text_key", "start", "windows", F.lit(None).cast("array<int>").alias("hits"))
        part = placed.filter("doc_id = head_id").join(found, ["anchor", "content"]).select("doc_id", "text_key", "start", "windows", "hits")
        return whole.unionByName(part)

    @staticmethod
    def _per_document(contents: DataFrame) -> DataFrame:
        one = F.struct("anchor", "content", "text_key", "start", "windows", "parts")
        return contents.groupBy(F.col("head_id").alias("doc_id")).agg(F.collect_list(one).alias("list"))

    def _by_shard(self, contents: DataFrame) -> DataFrame:
        size = contents.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
        shards = max(48, math.ceil(size / SHARD_WORDS))
        words = self._with_text(self._per_document(contents)).mapInArrow(_fetch_words, "anchor long, content long, doc_id long, words binary")
        # a repeated row brings its segments again; the index is none the worse, and hits are made distinct later
        return words.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(_search_shard, _HITS)

    def _by_window(self, contents: DataFrame) -> DataFrame:
        kind = "anchor long, part int, content long, doc_id long, places binary, windows binary"
        return self._with_text(self._per_document(contents)).mapInArrow(_fetch_windows, kind).groupBy("anchor", "part").applyInArrow(_lowest_windows, _HITS)

    def kept(self) -> DataFrame:
        """Every row with its counts, the digest of what stays, and the text that stays where something went."""
        lists = self.removed().groupBy("doc_id").agg(F.collect_set(F.struct("text_key", "start", "windows", "hits")).alias("list"))
        cut = self._with_text(lists).mapInArrow(_cut, "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string")
        cut = base.stored(cut.dropDuplicates(["doc_id", "text_key"]), "cut")
        rows = self.described.select("doc_id", "text_key", "n_words", "sha256")
        return rows.join(cut, ["doc_id", "text_key"], "left")


def report(docs: DataFrame) -> DataFrame:
    return Dedup(docs).kept().select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    )
