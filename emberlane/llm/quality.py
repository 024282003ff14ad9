"""Quality classifier: supervised subword embeddings.

Every word (case kept) and every run of 3 or 4 characters inside a word, with the spaces around it, is hashed to a bucket
with a learned vector; so is each word pair that says one word twice, all such pairs in one bucket. A document is the mean of its vectors over the whole text; a softmax over two classes gives the
score. Vectors and output layer are trained together by numpy stochastic gradient descent on at most ``SAMPLE_ROWS``
labelled rows (smallest hash of the id first), on the driver; a training text is reduced to counts per bucket while it
streams in. Only the text is an input; ids, languages, sources and labels of held-out rows are not.

Because the output layer is linear in the mean, scoring needs one number per bucket: the vector's difference of class
scores. That table of ``BUCKETS`` floats is the only thing broadcast. Null and empty texts have no features and get the
bias alone. Rows without a label or with a null label are not trained on; with no labels at all every score is 0.5.
Rows that repeat an id are scored by their own texts, an empty table gives no rows, a long text is one mean of its features;
only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .words import SPACED, split

BUCKETS = 1 << 18
#: Bound of the training sample, in labelled rows.
SAMPLE_ROWS = 3000
DIM = 8
EPOCHS = 5
BATCH = 64
RATE = 0.5
THRESHOLD = 0.7
#: Most bytes of text that are scored at once, and numbers of training texts that a task passes on at once.
PIECE, BAGS = 1 << 18, 1 << 20
#: The bucket of the word pair "the same word twice", whatever the word.
_REPEAT = 0
_SHIFT = np.uint64(64 - 18)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _ngrams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of n characters without white space inside, and the start of each."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = codes <= 32
    inner = np.zeros(size, bool)
    for j in range(1, n - 1):
        inner |= blank[j : j + size]
    inner |= blank[:size] & blank[n - 1 :]
    at = np.flatnonzero(~inner)
    wide = codes.astype(np.uint64)
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h += wide[at + j] * _MULTIPLIERS[j]
    return ((h * _MULTIPLIERS[0]) >> _SHIFT).astype(np.int64), at


def features(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (bucket, index of its text) that together hold every feature of the texts."""
    words = split(values, SPACED)
    owner = np.repeat(np.arange(len(values)), np.diff(words.bounds))
    yield ((words.hashes * _MULTIPLIERS[1]) >> _SHIFT).astype(np.int64), owner
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1]))
    yield np.full(len(again), _REPEAT), owner[again]
    decoded = [v.decode("utf-8", "replace") for v in values]
    codes = np.frombuffer((" " + " ".join(decoded) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in decoded])
    for n in (3, 4):
        bucket, at = _ngrams(codes, n)
        yield bucket, np.minimum(np.searchsorted(ends, at, "right"), len(values) - 1)


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, values: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(values)), np.zeros(len(values))
        for bucket, text in features(values):
            total += np.bincount(text, self.table[bucket], len(values))
            count += np.bincount(text, minlength=len(values))
        logit = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _bag(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    bucket, count = np.unique(np.concatenate([b for b, _ in features([value])]), return_counts=True)
    return bucket, (count / max(1, count.sum())).astype(np.float32)


def train(rows: Iterator[tuple[bytes, int]], seed: int = 7) -> Model:
    return train_bags([(_bag(value), int(label)) for value, label in rows], seed)


def train_bags(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], seed: int = 7) -> Model:
    """From ((buckets, weights), label)."""
    bags, labels = [b for b, _ in rows], [label for _, label in rows]
    if not labels:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    y = np.array(labels)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    output = (rng.random((DIM, 2), np.float32) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares, out_squares, bias_squares = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            batch = order[lo : lo + BATCH]
            index = np.concatenate([bags[i][0] for i in batch])
            weight = np.concatenate([bags[i][1] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            hidden = np.stack([np.bincount(doc, vectors[index, k] * weight, len(batch)) for k in range(DIM)], 1).astype(np.float32)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            error = (p / len(batch)).astype(np.float32)
            back = error @ output.T
            rows_used, inverse = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(inverse, weight * back[doc, k], len(rows_used)) for k in range(DIM)], 1).astype(np.float32)
            out_grad, bias_grad = hidden.T @ error, error.sum(0)
            squares[rows_used] += grad**2
            vectors[rows_used] -= rate * grad / np.sqrt(squares[rows_used])
            out_squares += out_grad**2
            output -= rate * out_grad / np.sqrt(out_squares)
            bias_squares += bias_grad**2
            bias -= 0.1 * rate * bias_grad / np.sqrt(bias_squares)
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts as buckets and weights."""
    base.forget()
    for batch in batches:
        values, size = base.as_bytes(batch.column(1)), 0
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for i, value in enumerate(values):
            bags.append(_bag(value or b""))
            size += len(bags[-1][0])
            if size > BAGS or i + 1 == len(values):
                # arrays as they are: as Python numbers they would take ten times the memory
                ends = pa.array(np.cumsum([0, *(len(b) for b, _ in bags)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([b[k] for b in bags]), kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
                mine = batch.slice(i + 1 - len(bags), len(bags))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(3), mine.column(2), *lists], ["doc_id", "content", "quality", "bucket", "weight"])
                bags, size = [], 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled rows whose crc32 remainder is not the held-out one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality in (0, 1)").filter(base.crc_remainder("doc_id", 4) != 2)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    source = base.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # sample_rows bounds the broadcast side
    rows = source.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality", F.xxhash64("text").alias("content"))
    # at most BUCKETS numbers a text reach the driver
    found = rows.mapInArrow(_bags, "doc_id long, content long, quality int, bucket array<int>, weight array<float>").toArrow()
    order = sorted(range(found.num_rows), key=list(zip(*(found[c].to_pylist() for c in ("doc_id", "content", "quality")))).__getitem__)
    numbers = lambda c, i: found[c][i].values.to_numpy()
    return train_bags([((numbers("bucket", i), numbers("weight", i)), found["quality"][i].as_py()) for i in order])


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for ids, values in base.pieces(batches, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.scores(values))], ["doc_id", "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(base.crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; trained on texts of ``training`` or of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs if training is None else training, labels))

    @F.pandas_udf("double")
    def quality(text):
        base.forget()
        model: Model = shared.value
        values = [b"" if t is None else t.encode("utf-8", "replace") for t in text]
        out = []
        lo = size = 0
        for i, v in enumerate(values):
            if size and size + len(v) > PIECE:
                out.append(model.scores(values[lo:i]))
                lo, size = i, 0
            size += len(v)
        if lo < len(values):
            out.append(model.scores(values[lo:]))
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.filter(quality(F.col("text").cast("string")) >= THRESHOLD)
