"""Gradient-boosted trees fitted to all rows of a table.

A pass of the rows per level of a tree adds up gradients and weights by node, feature and bin; tasks sum them up in a tree and
the driver, which sees no row, picks the splits from them. Several ensembles grow in the same passes: one for each fold,
from the rows of the others, and one from all. Gradients and weights are added as integers, multiples of 1 / ``UNIT``, so
that neither the order nor the partitions of the rows change a tree. Bins are cut at the quantiles of all rows.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_counts
from . import base

FOLDS = 4
TREES, DEPTH, SHRINK, BINS = 30, 3, 0.3, 32
#: Fewest rows of a node that is split.
LEAST_ROWS = 10
UNIT = 1 << 24
#: Rows of a partition of what the passes read; trees after which it is made anew with their scores.
PART_ROWS, KEEP_TREES = 10_000, 10

#: A complete tree as a heap: feature (-1: a leaf), bin, value; rows with a bin up to the split's go left.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1).astype(np.uint8)


def leaves(tree: Tree, bins: np.ndarray, levels: int = DEPTH) -> np.ndarray:
    """The nodes that rows are in after some levels."""
    feature, cut, _ = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        split = feature[at]
        at = np.where(split >= 0, 2 * at + 1 + (bins[rows, np.maximum(split, 0)] > cut[at]), at)
    return at


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, edges: list[np.ndarray], prior: float = 0.0):
        self.edges, self.prior = edges, prior
        self.trees: list[Tree] = []

    def raised(self, bins: np.ndarray, score: np.ndarray, first: int = 0) -> np.ndarray:
        """Scores with the values of the trees from the first on."""
        for tree in self.trees[first:]:
            score = score + tree[2][leaves(tree, bins)]
        return score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _share(self.raised(binned(x, self.edges), np.full(len(x), self.prior)))


def _share(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-score))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).copy()


def _value_counts(hide: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0))
            x[np.array(batch.column(1).to_pylist(), bool), x.shape[1] - hide :] = 0
            found = [np.unique(x[:, j], return_counts=True) for j in range(x.shape[1])]
            feature = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([n for _, n in found]))], ["feature", "value", "n"])

    return count


def edges(rows: DataFrame, n: int, hide: int = 0) -> list[np.ndarray]:
    """Per feature the distinct linearly interpolated quantiles of all n rows: where bins end."""
    counts = rows.select("features", "hidden").mapInArrow(_value_counts(hide), "feature int, value float, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)
    low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    places = np.unique(np.concatenate([low, high]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, value, size, upto = (batch.column(i).to_numpy() for i in range(4))
            upto = upto - feature.astype(np.int64) * n  # every feature has a value in every row
            first, last = np.searchsorted(places, upto - size), np.searchsorted(places, upto)
            which = [np.arange(a, b) for a, b in zip(first, last)]
            take = np.repeat(np.arange(len(which)), [len(w) for w in which])
            yield pa.RecordBatch.from_arrays([pa.array(feature[take]), pa.array(places[np.concatenate(which).astype(np.int64)] if which else places[:0]), pa.array(value[take])], ["feature", "place", "value"])

    found = running_counts(counts, ["feature", "value"], "n").select("feature", "value", "n", "_upto").mapInArrow(pick, "feature int, place long, value float").toArrow()
    feature, place, value = (found.column(i).to_numpy() for i in range(3))
    out = []
    for j in range(int(feature.max()) + 1):
        ordered = np.zeros(len(places))
        ordered[np.searchsorted(places, place[feature == j])] = value[feature == j]
        a, b = ordered[np.searchsorted(places, low)], ordered[np.searchsorted(places, high)]
        out.append(np.unique(a + (b - a) * (at - low)))
    return out


class Block:
    """Some training rows, in arrays; ``scores`` holds those of the first ``kept`` trees of every ensemble."""

    def __init__(self, kind: np.ndarray, y: np.ndarray, fold: np.ndarray, hidden: np.ndarray, weight: np.ndarray, bins: np.ndarray):
        self.kind, self.y, self.fold, self.hidden, self.weight, self.shown = kind, y, fold, np.flatnonzero(hidden), weight, bins
        self.scores: np.ndarray | None = None
        self.kept = 0

    def bins(self, zero: np.ndarray) -> np.ndarray:
        """Bins for training: the last features of hidden rows count as 0, whose bins are given."""
        out = self.shown.copy()
        out[self.hidden, out.shape[1] - len(zero) :] = zero
        return out

    def score(self, models: list[Trees], k: int, rows: np.ndarray, bins: np.ndarray) -> np.ndarray:
        before = np.full(len(rows), models[k].prior) if self.scores is None else self.scores[rows, k]
        return models[k].raised(bins, before, self.kept)

    def keep(self, models: list[Trees], zero: np.ndarray) -> Block:
        """The same rows with the scores of the trees so far."""
        out, bins, rows = copy.copy(self), self.bins(zero), np.arange(len(self.y))
        out.scores, out.kept = np.stack([self.score(models, k, rows, bins) for k in range(len(models))], 1), len(models[0].trees)
        return out

    def sums(self, models: list[Trees], growing: list[Tree], level: int, zero: np.ndarray) -> np.ndarray:
        """(rows, gradients, weights) by ensemble, node of the level, feature and bin."""
        nodes, every = 2**level, self.bins(zero)
        features = every.shape[1]
        out = np.zeros((3, len(models), nodes * features * BINS), np.int64)
        for k in range(len(models)):
            at = leaves(growing[k], every, level) - (nodes - 1)
            rows = np.flatnonzero((self.fold != k) & (at >= 0))
            bins, weight = every[rows], self.weight[rows]
            p = _share(self.score(models, k, rows, bins))
            gradient = np.rint((self.y[rows] - p) * weight * UNIT)
            second = np.rint(np.maximum(p * (1 - p), 1e-6) * weight * UNIT)
            cell = ((at[rows, None] * features + np.arange(features)) * BINS + bins).ravel()
            for i, add in enumerate((None, gradient, second)):
                out[i, k] = np.bincount(cell, None if add is None else np.repeat(add, features), out.shape[2])
        return out.reshape(3, len(models), nodes, features, BINS)


def _packer(cut: list[np.ndarray], weights: dict[str, float]):
    names = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kind = np.array([names.index(k) for k in batch.column(0).to_pylist()], np.uint8)
                y, fold = (batch.column(i).to_numpy().astype(np.uint8) for i in (1, 2))
                hidden = batch.column(3).to_numpy(zero_copy_only=False)
                block = Block(kind, y, fold, hidden, np.array(list(weights.values()))[kind], binned(_vectors(batch.column(4)), cut))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return run


def split(g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    """The feature and the last bin to the left with the largest gain, from gradients and weights by feature and bin."""
    gs, hs = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
    j, cut = np.unravel_index(gain.argmax(), gain.shape)
    return (int(j), int(cut)) if gain[j, cut] > 1e-6 else None


def _grow(blocks: RDD, models: list[Trees], zero: np.ndarray) -> None:
    """One more tree for every ensemble."""
    size = 2 ** (DEPTH + 1) - 1
    growing = [(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in models]
    for level in range(DEPTH):
        sums = blocks.map(lambda b: b.sums(models, growing, level, zero)).treeReduce(np.add).astype(np.float64)  # noqa: B023
        sums[1:] /= UNIT
        inner = False
        for k, (feature, cut, value) in enumerate(growing):
            for i in range(2**level):
                n, g, h = sums[:, k, i]
                node = 2**level - 1 + i
                if not n[0].sum():
                    continue
                value[node] = SHRINK * g[0].sum() / (h[0].sum() + 1)
                if n[0].sum() >= LEAST_ROWS and (best := split(g, h)):
                    j, last = best
                    feature[node], cut[node], inner = j, last, True
                    for child, part in ((2 * node + 1, slice(None, last + 1)), (2 * node + 2, slice(last + 1, None))):
                        value[child] = SHRINK * g[j, part].sum() / (h[j, part].sum() + 1)
        if not inner:
            break
    for m, tree in zip(models, growing):
        m.trees.append(tree)


def _prior(counts: list[tuple[float, int, int]]) -> float:
    """Log odds of label 1 from (weight, label, rows)."""
    whole = sum(w * n for w, _, n in counts)
    mean = min(max(sum(w * n * y for w, y, n in counts) / whole, 1e-3), 1 - 1e-3) if whole else 0.5
    return math.log(mean / (1 - mean))


def fit(rows: DataFrame, weights: dict[str, float], counts: list[tuple[str, int, int, int]], hide: int = 0) -> tuple[list[Trees], DataFrame]:
    """An ensemble per fold from the rows of the others and one from all, and the rows with their bins.

    Rows are kind, y, fold, hidden and features; the last ``hide`` features of hidden rows count as 0 in training. ``weights``
    are those of the kinds, ``counts`` the rows by (kind, fold, y).
    """
    n = sum(c[3] for c in counts)
    cut = edges(rows, n, hide)
    state = rows.select("kind", "y", "fold", "hidden", "features").repartition(1 + n // PART_ROWS)
    state = base.stored(state.mapInArrow(_packer(cut, weights), "block binary"), "blocks")
    models = [Trees(cut, _prior([(weights[kind], y, c) for kind, fold, y, c in counts if fold != k])) for k in range(FOLDS + 1)]
    zero = np.array([np.searchsorted(e, 0.0, "right") for e in cut[len(cut) - hide :]], np.uint8)
    blocks = state.rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    for t in range(TREES):
        if t and t % KEEP_TREES == 0:
            known = list(models)
            scored = blocks.map(lambda b: b.keep(known, zero)).persist(StorageLevel.MEMORY_AND_DISK)  # noqa: B023
            scored.count()
            blocks.unpersist()
            blocks = scored
        _grow(blocks, models, zero)
    blocks.unpersist()
    return models, state


def unseen(state: DataFrame, models: list[Trees], kinds: list[str]) -> DataFrame:
    """kind, y and the score p that a row has from the trees that haven't seen its fold; nothing is hidden."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                b = pickle.loads(packed.as_py())
                p = np.empty(len(b.y))
                for k in range(FOLDS):
                    mine = np.flatnonzero(b.fold == k)
                    p[mine] = _share(b.score(models, k, mine, b.shown[mine]))
                yield pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in b.kind], pa.string()), pa.array(b.y.astype(np.int32)), pa.array(p)], ["kind", "y", "p"])

    return state.mapInArrow(run, "kind string, y int, p double")
