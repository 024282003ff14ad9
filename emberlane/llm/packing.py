"""Packing token sequences: non-negative least squares over shallow length combinations.

A document is its token ids and an end id. It is cut into full windows, one piece that is a multiple of ``UNIT`` tokens
and a tail of fewer. Only the histogram of piece lengths (at most a few hundred numbers, whatever the input) goes to the
driver. There, combinations of two to four unit lengths that fill a window exactly are enumerated, their repeat counts
solved by non-negative least squares against the histogram and rounded down; what rounding leaves is laid end to end and
cut at window borders, and tails fill windows greedily, longest first. Each piece knows its rank among the pieces of its
length (a count inside its task plus the counts of earlier tasks), and the rank alone gives its sequence and offset: no
group of documents ever meets in one task.

The last residual window is closed at powers of two, so that it needs no padding; only the last tail windows are padded.
Null texts are empty: one piece that holds the end id. Repeated documents are packed like any other rows; equal lengths are
told apart by task and place alone. An empty table gives no pieces. Texts of any length are encoded in slices.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 4096
UNIT = 64
END_ID = 2
DEPTH = 4
TOKENIZER = "word_bpe_49k.json"
#: Bytes of remembered parts in a worker; beyond it the memory is emptied and filled again, with the same results.
CACHE_BYTES = 64 << 20
#: What Python spends on a remembered part besides its characters and ids.
_ENTRY_BYTES = 200

_PIECES = "doc_id long, start long, length int, doc_tokens long, crcs array<long>, part int, k long"
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of whole texts as little-endian bytes, by remembering each letter run, digit and mark run.

    The tokenizer lower-cases, and never looks across white space nor across the borders of such parts. Words of ASCII and
    Latin-1 letters, digits and marks are taken apart with one pattern; new letter runs are encoded many at a time, told
    apart by the word-end tokens. Any other word (other characters, apostrophes, special strings) goes to the tokenizer
    as it is.
    """

    _ODD = re.compile(r"[^\t-\r !-&(-~À-ÖØ-öø-ÿ]|<\|")
    _PLAIN = bytes([*range(9, 14), *range(32, 39), *range(40, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    #: Latin-1 in lower case, and the class of each character: 0 white space, 1 letter, 2 digit, 3 mark.
    _LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
    _CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if 97 <= c <= 122 or c >= 0xDF else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.uint8)
    _SPACES = re.compile(r"[\t-\r ]+")
    #: Marks an odd word among the remembered parts.
    _WHOLE = b"\0"
    _JOINED = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1 where all of its words are plain."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, self._PLAIN) or b"<|" in raw else raw

    def _parts(self, raw: bytes) -> list[bytes]:
        """Letter runs, digits and mark runs of plain Latin-1."""
        raw = raw.translate(self._LOWER)
        buf = np.frombuffer(raw, np.uint8)
        kind = self._CLASS[buf]
        cut = np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
        return (np.insert(buf, cut, 32).tobytes() if len(cut) else raw).split()

    def _split(self, text: str) -> list[bytes]:
        raw = self._plain(text)
        if raw is not None:
            return self._parts(raw)
        out: list[bytes] = []
        for word in self._SPACES.split(text):
            if self._ODD.search(word):
                out.append(self._WHOLE + word.encode())
            elif word:
                out += self._parts(word.encode("latin-1"))
        return out

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, parts: set[bytes]) -> None:
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        letters = [p for p in parts if self._CLASS[p[0]] == 1]
        other = [p for p in parts if self._CLASS[p[0]] != 1]
        groups = [letters[i : i + self._JOINED] for i in range(0, len(letters), self._JOINED)]
        known = self.known
        for group, ids in zip(groups, self._encode([b" ".join(g).decode("latin-1") for g in groups])):
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            raw, at = ids.tobytes(), 0
            for part, end in zip(group, (4 * ends).tolist()):
                known[part] = raw[at:end]
                at = end
            self.size += len(raw)
        for part, ids in zip(other, self._encode([p[1:].decode() if p[:1] == self._WHOLE else p.decode("latin-1") for p in other])):
            known[part] = ids.tobytes()
            self.size += 4 * len(ids)
        self.size += sum(map(len, parts)) + _ENTRY_BYTES * len(parts)

    def _known(self, texts: list[bytes]) -> list[bytes]:
        split = [self._split(t.decode("utf-8", "replace")) for t in texts]
        found = set().union(*split)
        new = found.difference(self.known)
        if new:
            # learning may empty the memory, which must then hold all of these texts
            self._learn(found if self.size > CACHE_BYTES else new)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def __call__(self, values: list[bytes]) -> list[bytes]:
        """Ids of texts that are a piece together; a text beyond a piece is taken in slices."""
        if len(values) == 1:
            return [b"".join(self._known([part])[0] for part in base.slices(values[0]))]
        return self._known(values)


def _encoder(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    return base.remembered(f"packing {path}", lambda: WordIds(path))


def _cutter(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts, part = _encoder(path), Counter(), TaskContext.get().partitionId()
        for ids, values in base.pieces(batches):
            rows: list[tuple] = []
            for doc, tokens in zip(ids, encode(values)):
                tokens = memoryview(tokens + end)
                n = len(tokens) // 4
                start = 0
                while start < n:
                    length = WINDOW if n - start >= WINDOW else (n - start) // UNIT * UNIT or n - start
                    step = UNIT if UNIT <= length < WINDOW else length
                    crc, crcs = 0, []
                    for at in range(start, start + length, step):
                        crc = zlib.crc32(tokens[4 * at : 4 * (at + step)], crc)
                        crcs.append(crc)
                    rows.append((doc, start, length, n, crcs, part, counts[length]))
                    counts[length] += 1
                    start += length
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "doc_tokens", "crcs", "part", "k"]
            )

    return cut


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes |ax - b| least (active sets)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if active.all() or slope.max() <= 1e-10:
            break
        active[slope.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z[active].min(initial=1) > 0:
                x = z
                break
            bad = active & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-14
            x[~active] = 0
    return x


def combinations(units: int, present: list[int], depth: int) -> list[tuple[int, ...]]:
    """Multisets of two to ``depth`` of the present lengths (in units) that sum to ``units``, longest first."""
    known, out = set(present), []
    for n in range(2, depth + 1):
        for head in itertools.combinations_with_replacement(sorted(present, reverse=True), n - 1):
            last = units - sum(head)
            if 0 < last <= head[-1] and last in known:
                out.append((*head, last))
    return out


@dataclass
class Layout:
    """Where the r-th piece of each length goes."""

    #: length -> rows (first rank, pieces per sequence, first sequence, offset), ordered by rank
    blocks: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    #: length -> (first rank that is laid end to end, its position there)
    residual: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: length of the end-to-end stream, the borders of its windows behind the last full one, and the sequence of its first
    laid: int = 0
    borders: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    first_residual: int = 0
    sequences: int = 0

    @classmethod
    def of(cls, histogram: dict[int, int]) -> Layout:
        out = cls()
        full = histogram.get(WINDOW, 0)
        out.blocks[WINDOW] = [(0, 1, 0, 0)]
        out.sequences = full
        left = {n: c for n, c in histogram.items() if n < WINDOW and n % UNIT == 0}
        used: Counter = Counter()
        present = sorted(n // UNIT for n in left)
        patterns = combinations(WINDOW // UNIT, present, DEPTH)
        if patterns:
            row = {u: i for i, u in enumerate(present)}
            a = np.zeros((len(present), len(patterns)))
            for j, p in enumerate(patterns):
                for u in p:
                    a[row[u], j] += 1
            target = np.array([left[u * UNIT] for u in present], float)
            counts = nnls(a, target / target.max()) * target.max()
            for j in np.argsort(-counts):
                content = Counter(u * UNIT for u in patterns[j])
                repeats = min(int(counts[j]), *((left[n] - used[n]) // m for n, m in content.items()))
                if repeats > 0:
                    out._place(content, repeats, used)
        at = 0
        for n in sorted(left, reverse=True):
            out.residual[n] = (used[n], at)
            at += (left[n] - used[n]) * n
        border = at // WINDOW * WINDOW
        ends = [border]
        for bit in range(WINDOW.bit_length(), -1, -1):
            if at % WINDOW & (1 << bit):
                border += 1 << bit
                ends.append(border)
        out.laid, out.borders = at, np.array(ends, np.int64)
        out.first_residual = out.sequences
        out.sequences += at // WINDOW + len(ends) - 1
        tails = {n: c for n, c in histogram.items() if n % UNIT}
        used = Counter()
        while any(tails[n] > used[n] for n in tails):
            room, content = WINDOW, Counter()
            for n in sorted(tails, reverse=True):
                if take := min(tails[n] - used[n], room // n):
                    content[n] = take
                    room -= take * n
            out._place(content, min((tails[n] - used[n]) // m for n, m in content.items()), used)
        return out

    def _place(self, content: Counter, repeats: int, used: Counter) -> None:
        offset = 0
        for n, m in content.items():
            self.blocks.setdefault(n, []).append((used[n], m, self.sequences, offset))
            used[n] += repeats * m
            offset += n * m
        self.sequences += repeats

    def window(self, at: int) -> tuple[int, int, int]:
        """(number, start, end) of the end-to-end window at a position of the stream."""
        full = self.laid // WINDOW
        if at < full * WINDOW:
            return at // WINDOW, at // WINDOW * WINDOW, (at // WINDOW + 1) * WINDOW
        i = int(np.searchsorted(self.borders, at, "right")) - 1
        return full + i, int(self.borders[i]), int(self.borders[i + 1])

    def locate(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, position in the end-to-end stream or -1) of the pieces of this length with these ranks."""
        sequence, offset, stream = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64)
        blocks = np.array(self.blocks.get(length, []), np.int64).reshape(-1, 4)
        cut, at = self.residual.get(length, (np.iinfo(np.int64).max, 0))
        laid = rank >= cut
        stream[laid] = at + (rank[laid] - cut) * length
        if len(blocks) and not laid.all():
            r = rank[~laid]
            first, per, base_sequence, base_offset = blocks[np.searchsorted(blocks[:, 0], r, "right") - 1].T
            sequence[~laid] = base_sequence + (r - first) // per
            offset[~laid] = base_offset + (r - first) % per * length
        return sequence, offset, stream


def _power(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc_of_rest(before: int, whole: int, n_bytes: int) -> int:
    """crc32 of B from those of A and A+B: appending zero bytes is linear over bits."""
    matrix = [0xEDB88320] + [1 << i for i in range(31)]
    square = lambda m: [_power(m, x) for x in m]
    matrix = square(square(square(matrix)))
    while n_bytes:
        if n_bytes & 1:
            before = _power(matrix, before)
        n_bytes >>= 1
        matrix = square(matrix)
    return before ^ whole


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout: Layout = shared.value
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            doc, crcs = col["doc_id"].to_pylist(), col["crcs"].to_pylist()
            start, length, tokens, rank = (np.asarray(col[n]).astype(np.int64) for n in ("start", "length", "doc_tokens", "rank"))
            sequence, offset, stream = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.full(len(doc), -1, np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                sequence[at], offset[at], stream[at] = layout.locate(n, rank[at])
            rows = []
            for i in range(len(doc)):
                if stream[i] < 0:
                    rows.append((doc[i], int(start[i]), int(length[i]), crcs[i][-1], int(tokens[i]), int(sequence[i]), int(offset[i])))
                    continue
                at, end, done = int(stream[i]), int(stream[i] + length[i]), 0
                while at < end:
                    w, first, last = layout.window(at)
                    stop = min(end, last)
                    n = stop - at
                    before = crcs[i][done // UNIT - 1] if done else 0
                    crc = crc_of_rest(before, crcs[i][(done + n) // UNIT - 1], 4 * n) if done else crcs[i][n // UNIT - 1]
                    rows.append((doc[i], int(start[i]) + done, n, crc, int(tokens[i]), layout.first_residual + w, at - first))
                    at, done = stop, done + n
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of each document, with its sequence and its offset there."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    source = base.texts(docs).select(F.col("doc_id").cast("long"), "text")
    cut = base.stored(source.mapInArrow(_cutter(tokenizer_path, END_ID), _PIECES), "pieces")
    counts = base.stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Layout.of(histogram))
    before = counts.selectExpr(
        "length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before"
    )
    ranked = cut.join(before, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "crcs", (F.col("before") + F.col("k")).alias("rank")
    )
    return ranked.mapInArrow(_placer(shared), _OUT)
