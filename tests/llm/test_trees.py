"""The boosted trees of personal data learn from every labelled candidate (F8)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from emberlane.llm import pii, trees

FOUND = "doc_id long, content long, candidates array<struct<kind:string,start:long,end:long,label:int,features:array<float>>>"


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]) -> trees.Trees:
    """The plain fit of all rows in memory, node by node."""
    mean = (weight * y).sum() / weight.sum()
    model = trees.Trees(edges, math.log(mean / (1 - mean)))
    bins, score = trees.binned(x, edges), np.full(len(y), model.prior)
    for _ in range(trees.TREES):
        p = 1 / (1 + np.exp(-score))
        grad, second = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        size = 2 ** (trees.DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        rows_of = {0: np.arange(len(y))}
        for node in range(size):
            if (rows := rows_of.pop(node, None)) is None:
                continue
            value[node] = trees.SHRINK * grad[rows].sum() / (second[rows].sum() + 1)
            if node >= 2**trees.DEPTH - 1 or len(rows) < trees.LEAST_ROWS:
                continue
            sums = [np.array([np.bincount(bins[rows, j], v[rows], trees.BINS) for j in range(x.shape[1])]) for v in (grad, second)]
            if best := trees.split(*sums):
                feature[node], cut[node] = best
                left = bins[rows, best[0]] <= best[1]
                rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[left], rows[~left]
        model.trees.append((feature, cut, value))
        score = model.raised(bins, score, len(model.trees) - 1)
    return model


def test_trees_equal_a_fit_in_memory(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4)).astype(np.float32)
    x[:, 1] = np.round(x[:, 1])
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=1500) > 0.5).astype(int)
    kind, fold, hidden = np.where(rng.random(1500) < 0.2, "contact", "number"), rng.integers(0, trees.FOLDS, 1500), rng.random(1500) < 0.5
    rows = spark.createDataFrame([(str(kind[i]), int(y[i]), int(fold[i]), bool(hidden[i]), x[i].tolist()) for i in range(1500)], "kind string, y int, fold int, hidden boolean, features array<float>")
    weights = {"contact": 1.0, "number": 0.25}
    counts = [tuple(r) for r in rows.groupBy("kind", "fold", "y").count().collect()]
    models, state = trees.fit(rows.repartition(5), weights, counts, 1)
    used = x.copy()
    used[hidden, 3] = 0
    edges = [np.unique(np.quantile(used[:, j].astype(np.float64), np.linspace(0, 1, trees.BINS + 1)[1:-1])) for j in range(4)]
    assert all(np.allclose(a, b, atol=1e-12, rtol=0) for a, b in zip(models[0].edges, edges, strict=True))
    weight = np.array([weights[k] for k in kind])
    for k in (1, trees.FOLDS):
        want = fitted(used[fold != k], y[fold != k], weight[fold != k], models[0].edges)
        assert np.allclose(models[k].scores(x), want.scores(x), atol=1e-4) and len(models[k].trees) == trees.TREES
    got = sorted((r.kind, r.y, round(r.p, 9)) for r in trees.unseen(state, models, list(weights)).collect())
    p = np.choose(fold, [m.scores(x) for m in models[: trees.FOLDS]])
    assert got == sorted((str(a), int(b), round(float(c), 9)) for a, b, c in zip(kind, y, p))


def test_every_labelled_candidate_counts(spark):
    """More numbers than any bound of a sample would let in; the model is that of all of them, in whatever partitions."""
    rng = np.random.default_rng(5)
    n, few, width = 9000, 300, len(pii.FEATURES)
    kinds = ["number"] * n + ["contact"] * few
    x = rng.random((n + few, width)).round(2).astype(np.float32)
    y = (x[:, 3] + 0.3 * rng.random(n + few) > 0.7).astype(int)
    found = spark.createDataFrame([(i, i, [(kinds[i], 0, 9, int(y[i]), x[i].tolist())]) for i in range(n + few)], FOUND)
    a, b = pii.fit(found.repartition(3)), pii.fit(found.repartition(8))
    weight = np.where(np.arange(n + few) < n, few / n, 1.0)
    mean = (weight * y).sum() / weight.sum()
    assert math.isclose(a.trees.prior, math.log(mean / (1 - mean)), rel_tol=1e-9)
    # the hidden features are 0 in half of the rows
    for j in range(width - pii.NAMING):
        assert np.allclose(a.trees.edges[j], np.unique(np.quantile(x[:, j].astype(np.float64), np.linspace(0, 1, trees.BINS + 1)[1:-1])), atol=1e-12, rtol=0)
    assert a.thresholds == b.thresholds and a.trees.prior == b.trees.prior and a.thresholds["number"] < 1
    assert all(np.array_equal(s, t) for one, other in zip(a.trees.trees, b.trees.trees, strict=True) for s, t in zip(one, other))


def test_thresholds_count_all_scores(spark):
    rng = np.random.default_rng(9)
    p = rng.integers(1, 400, 6000) / 400
    kind = rng.choice(["contact", "number"], 6000)
    y = (rng.random(6000) < np.where(p > 0.8, 0.995, p)).astype(int)
    got = pii.cut_scores(spark.createDataFrame([(str(k), int(a), float(b)) for k, a, b in zip(kind, y, p)], "kind string, y int, p double").repartition(6, F.col("p")))
    for k in ("contact", "number"):
        ok = [s for s in np.unique(p[kind == k]) if 1000 * y[(kind == k) & (p >= s)].sum() >= round(1000 * pii.PRECISION) * ((kind == k) & (p >= s)).sum()]
        assert got[k] == max(0.5, min(ok)) < 1
    assert got["secret"] == math.inf
