"""Many Cox fits over one scan: specifications, populations and bootstrap replicas advance together.

A fit is a specification (covariates, a condition on rows, strata) with or without a replica of the cluster bootstrap. Every
Newton round is one job for all fits that are not done: tasks add up, per block of fits, stratum and time, the sums over
rows at risk and over deaths (one matrix product per time for all replicas of a block), partial sums meet by block, stratum
and time, and are then evaluated by block and stratum. What reaches the driver is a log likelihood, a gradient and an
information matrix per fit and shuffle partition, whatever the number of rows, times and strata.

A replica's weight of a row is a Poisson(1) number from a hash of seed, replica and cluster, so that all rows of a cluster
travel together, no draw is stored and none is joined. Weights are frequencies: a weight of two is the same as two rows.

Rows with a null among a specification's covariates, times or event are no rows of it; a null condition is false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .survival import CoxFit, _tied

#: Most fits of a block: its sums of one time are one binary value.
BLOCK = 64
#: Specifications whose rows are marked in one number.
BITS = 60
#: Values that a task holds before it passes partial sums on.
HELD = 1 << 22
_PARTIAL = "block int, stratum string, time double, sums binary"


@dataclass(frozen=True)
class Spec:
    """A specification: covariates of rows for which ``where`` (an SQL condition) holds, with risk sets within ``strata``."""

    name: str
    covariates: tuple[str, ...]
    where: str = "true"
    strata: str | None = None


def _inverse(info: np.ndarray) -> np.ndarray:
    """The pseudoinverse, not a number where the information has none (no fit fails the others of its battery)."""
    try:
        return np.linalg.pinv(info, hermitian=True)
    except np.linalg.LinAlgError:
        return np.full(info.shape, math.nan)


@dataclass
class _State:
    """One fit on its way."""

    spec: int
    replica: int  # 0: all rows count once
    cluster: int = 0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trial: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    ll: float = -math.inf
    null: float = math.nan
    info: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    done: bool = False
    converged: bool = False

    def advance(self, ll: float, grad: np.ndarray, info: np.ndarray) -> None:
        """Take what an evaluation at the trial point gave: accept it and go on, or halve the step."""
        if math.isnan(self.null):
            self.null = ll
        elif not ll >= self.ll - 1e-9 * (1 + abs(self.ll)) and self.scale > 1e-3:
            self.scale /= 2
            self.trial = self.beta + self.scale * self.step
            return
        elif not (np.isfinite(ll) and np.isfinite(grad).all() and np.isfinite(info).all()):
            # no number at any part of the step: the last point that had one stays
            self.done = True
            return
        self.beta, self.ll, self.info, self.scale = self.trial, ll, info, 1.0
        if not (np.isfinite(grad).all() and np.isfinite(info).all()):
            self.done = True
            return
        self.step = _inverse(info) @ grad
        if not np.isfinite(self.step).all():
            self.done = True
            return
        gain = float(grad @ self.step)
        if gain < 1e-7 * (1 + abs(ll)) * 1e-3:
            # the error left is of second order in this step, which is taken without another look
            self.beta, self.done, self.converged = self.beta + self.step, True, True
        self.trial = self.beta + self.step


def _drawn(cluster: np.ndarray, replicas: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) numbers by distinct cluster and replica, and each row's place among the clusters; replica 0 has weight 1."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])
    cuts = np.array([int(min(s, 1 - 2.0**-53) * 2.0**64) for s in shares], np.uint64)
    known, inverse = np.unique(cluster.view(np.uint64), return_inverse=True)
    turn = np.array(replicas, np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
    x = known[:, None] + turn[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    w = np.zeros(x.shape, np.uint8)
    for cut in cuts[:5]:
        w += x >= cut
    rest = x >= cuts[4]
    w[rest] = np.searchsorted(cuts, x[rest], "right")
    w[:, np.array(replicas) == 0] = 1
    return w.astype(float), inverse


def _weights(cluster: np.ndarray, replicas: list[int], seed: int) -> np.ndarray:
    """Poisson(1) numbers by row and replica."""
    drawn, inverse = _drawn(cluster, replicas, seed)
    return drawn[inverse]


def _moments(p: int) -> tuple[int, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(p)
    return 1 + p + len(i), i, j


def _group_sums(weights: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of rows between cuts: weights (rows x fits) transposed times values (rows x moments)."""
    if weights.shape[1] <= 2:
        parts = [np.add.reduceat(weights[:, k : k + 1] * values, cuts, axis=0) for k in range(weights.shape[1])]
        return np.stack(parts, 1)
    ends = [*cuts[1:].tolist(), len(values)]
    return np.stack([weights[lo:hi].T @ values[lo:hi] for lo, hi in zip(cuts.tolist(), ends)])


#: Rows that a task takes at once.
_ROWS = 1 << 15


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class _View:
    """A batch's rows of one specification, by stratum, time and whether they die."""

    rows: np.ndarray
    x: np.ndarray
    values: np.ndarray
    names: list[str]
    codes: np.ndarray
    stop: np.ndarray
    dead: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, x_all: np.ndarray, spec: int, picked: list[int], strata: bool) -> _View:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        rows = np.flatnonzero((column(f"in{spec // BITS}").to_numpy(zero_copy_only=False) >> (spec % BITS) & 1).astype(bool))
        names, codes = [""], np.zeros(len(rows), np.int64)
        if strata:
            coded = column(f"s{spec}").take(pa.array(rows)).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        stop, dead = column("stop").to_numpy(zero_copy_only=False)[rows], column("dead").to_numpy(zero_copy_only=False)[rows] == 1
        order = np.lexsort((dead, stop, codes))
        rows, codes, stop, dead = rows[order], codes[order], stop[order], dead[order]
        x = x_all[rows][:, picked]
        _, i, j = _moments(len(picked))
        values = np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)
        new = (stop[1:] != stop[:-1]) | (codes[1:] != codes[:-1]) | (dead[1:] != dead[:-1])
        return cls(rows, x, values, names, codes, stop, dead, np.flatnonzero(np.concatenate([[len(rows) > 0], new])))


def _partial_sums(shared, p_all: int):
    """Sums of a task's rows by block, stratum and time: at risk from below (stops less starts), deaths' moments, death counts.

    Rows are put in order once per specification; blocks with the same draws follow each other, which are then let go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specs, blocks, seed, starts = shared.value
        turns: dict[tuple, list[int]] = {}
        for number, (_, states) in enumerate(blocks):
            turns.setdefault((states[0][1], *(r for r, _, _ in states)), []).append(number)
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def add(key: tuple, at: slice, sums: np.ndarray, shape: tuple) -> None:
            nonlocal size
            if key not in held:
                held[key] = np.zeros(shape)
                size += held[key].size
            held[key][:, at] += sums

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            keys = list(held)
            if keys:
                columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k].tobytes() for k in keys], pa.binary())], ["block", "stratum", "time", "sums"])
            held.clear()
            size = 0

        def block_sums(number: int, view: _View, w: np.ndarray, start: np.ndarray) -> None:
            states = blocks[number][1]
            p = view.x.shape[1]
            q = view.values.shape[1]
            shape = (len(states), 3 * q + 1 + p)
            beta = np.stack([b for _, _, b in states], 1)
            if (beta == beta[:, :1]).all():
                # a first round: one risk for all replicas
                e = np.exp(np.minimum(view.x @ beta[:, :1], 700))
                at_risk, risk_values = w, e * view.values
            else:
                at_risk = view.x @ beta
                np.minimum(at_risk, 700, out=at_risk)
                np.exp(at_risk, out=at_risk)
                at_risk *= w
                risk_values = view.values
            for cut, end, sums in zip(view.cuts.tolist(), [*view.cuts[1:].tolist(), len(view.rows)], _group_sums(at_risk, risk_values, view.cuts)):
                key = (number, view.names[view.codes[cut]], float(view.stop[cut]))
                add(key, slice(0, q), sums, shape)
                if view.dead[cut]:
                    add(key, slice(2 * q, 3 * q), sums, shape)
                    add(key, slice(3 * q, 3 * q + 1 + p), w[cut:end].T @ view.values[cut:end, : 1 + p], shape)
            if starts:
                t = start[view.rows]
                order = np.lexsort((t, view.codes))
                t, c = t[order], view.codes[order]
                cuts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]))
                for cut, sums in zip(cuts.tolist(), _group_sums(at_risk[order], risk_values[order], cuts)):
                    add((number, view.names[c[cut]], float(t[cut])), slice(q, 2 * q), sums, shape)

        for batch in _joined(batches):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x_all = np.stack([columns[f"x{k}"].to_numpy(zero_copy_only=False) for k in range(p_all)], 1) if p_all else np.zeros((batch.num_rows, 0))
            start = columns["start"].to_numpy(zero_copy_only=False)
            views: dict[int, _View] = {}
            for (cluster, *replicas), numbers in turns.items():
                if any(replicas):
                    drawn, place = _drawn(columns[f"c{cluster}"].to_numpy(zero_copy_only=False), replicas, seed + cluster)
                for number in numbers:  # specifications share their replicas' draws
                    spec = blocks[number][0]
                    view = views.get(spec) or views.setdefault(spec, _View.of(batch, x_all, spec, *specs[spec]))
                    if len(view.rows):
                        block_sums(number, view, drawn[place[view.rows]] if any(replicas) else np.ones((len(view.rows), len(replicas))), start)
            if size > HELD:
                yield from passed()
        yield from passed()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> dict[tuple, np.ndarray]:
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for block, stratum, time, sums in zip(*(batch.column(i).to_pylist() for i in range(4))):
            key, value = (block, stratum, time), np.frombuffer(sums)
            held[key] = held[key] + value if key in held else value
    return held


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _added(batches)
    keys = list(held)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.float64()))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k].tobytes() for k in keys], pa.binary())], ["block", "stratum", "time", "sums"])


def _ties(risk: np.ndarray, dead: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_tied`` for several fits: six sums each."""
    out = np.zeros((6, len(n)))
    many = n > 2048
    for k in np.flatnonzero(many).tolist():
        out[:, k] = _tied(risk[k], dead[k], int(n[k]))
    some = np.flatnonzero(~many & (n > 0))
    if len(some):
        k = np.arange(int(n[some].max()))
        a = k / n[some][:, None]
        s = np.where(k < n[some][:, None], risk[some][:, None] - a * dead[some][:, None], np.inf)
        s1 = 1 / s
        s2 = s1 * s1
        logs = np.log(np.where(np.isinf(s), 1.0, s))
        out[:, some] = [logs.sum(1), s1.sum(1), (a * s1).sum(1), s2.sum(1), (a * s2).sum(1), (a * a * s2).sum(1)]
    return out


def likelihoods(times: np.ndarray, p: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods, gradients and informations of a block's fits in one stratum, with Efron's ties.

    ``times``: sums by rising time and fit; ``beta``: coefficients by fit.
    """
    q, i, j = _moments(p)
    fits = times.shape[1]
    risk = times[:, :, :q][::-1].cumsum(0)[::-1] - times[:, :, q : 2 * q][::-1].cumsum(0)[::-1]
    ll, grad, flat = np.zeros(fits), np.zeros((fits, p)), np.zeros((fits, len(i)))
    for t in np.flatnonzero((times[:, :, 3 * q] > 0).any(1)):
        n = np.rint(times[t, :, 3 * q])
        r, e, x = risk[t], times[t, :, 2 * q : 3 * q], times[t, :, 3 * q + 1 :]
        logs, s1, a1, s2, a2, aa2 = (v[:, None] for v in _ties(r[:, 0], e[:, 0], n))
        r1, e1 = r[:, 1 : 1 + p], e[:, 1 : 1 + p]
        ll += (x * beta).sum(1) - logs[:, 0]
        grad += x - (r1 * s1 - e1 * a1)
        flat += r[:, 1 + p :] * s1 - e[:, 1 + p :] * a1
        flat -= r1[:, i] * r1[:, j] * s2 - (r1[:, i] * e1[:, j] + e1[:, i] * r1[:, j]) * a2 + e1[:, i] * e1[:, j] * aa2
    info = np.zeros((fits, p, p))
    info[:, i, j] = flat
    info[:, j, i] = flat
    return ll, grad, info


def _evaluator(shared):
    """Per block the likelihoods of its fits, over the strata of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specs, blocks, *_ = shared.value
        strata: dict[tuple, list] = {}
        for (block, stratum, time), sums in _added(batches).items():
            strata.setdefault((block, stratum), []).append((time, sums))
        found: dict[int, np.ndarray] = {}
        for (block, _), rows in strata.items():
            spec, states = blocks[block]
            p = len(specs[spec][0])
            rows.sort(key=lambda r: r[0])
            sums = np.stack([s for _, s in rows]).reshape(len(rows), len(states), -1)
            out = found.setdefault(block, np.zeros((len(states), 1 + p + p * p)))
            ll, grad, info = likelihoods(sums, p, np.stack([beta for _, _, beta in states]))
            out += np.concatenate([ll[:, None], grad, info.reshape(len(states), -1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["block", "found"])

    return run


class Table:
    """Rows ready for many fits: the union of covariates (centred), conditions, strata and clusters, written once."""

    def __init__(self, rows: DataFrame, specs: list[Spec], stop: str, event: str, start: str | None = None, clusters: list[str] | None = None, seed: int = 3, id_column: str | None = None):
        self.specs, self.clusters, self.seed = specs, clusters or [], seed
        self.covariates = list(dict.fromkeys(c for s in specs for c in s.covariates))
        self.spark = rows.sparkSession
        whole = F.col(stop).isNotNull() & F.col(event).isNotNull()
        p, n = len(self.covariates), len(specs)

        def rows_of(s: Spec):
            known = reduce(lambda a, c: a & F.col(c).isNotNull(), s.covariates, F.coalesce(F.expr(s.where), F.lit(False)))
            return F.coalesce(known, F.lit(False))

        data = rows.filter(whole).select(
            *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.covariates)),
            F.col(stop).cast("double").alias("stop"),
            (F.col(start).cast("double") if start else F.lit(0.0)).alias("start"),
            F.col(event).cast("int").alias("dead"),
            *(reduce(lambda a, k: a + F.when(rows_of(specs[k]), 1 << (k % BITS)).otherwise(0), range(lo, min(lo + BITS, n)), F.lit(0).cast("long")).alias(f"in{lo // BITS}") for lo in range(0, n, BITS)),
            *(F.coalesce(F.col(s.strata).cast("string"), F.lit("")).alias(f"s{k}") for k, s in enumerate(specs) if s.strata),
            *(F.xxhash64(c).alias(f"c{k}") for k, c in enumerate(self.clusters)),
            *([F.col(id_column).alias("id")] if id_column else []),
        )
        self.data = stored(data, "fits")
        # sums by which specifications a row belongs to: few combinations
        masks = [f"in{k}" for k in range(-(-n // BITS))]
        sums = [F.sum(f"x{k}").alias(f"x{k}") for k in range(p)] + [F.count(f"x{k}").alias(f"n{k}") for k in range(p)]
        found = self.data.groupBy(*masks).agg(F.count("*").alias("rows"), F.sum("dead").alias("deaths"), F.max("start").alias("started"), F.min("stop").alias("stopped"), *sums).collect()
        inside = lambda r, k: r[f"in{k // BITS}"] >> (k % BITS) & 1
        self.means = np.array([sum(r[f"x{k}"] or 0.0 for r in found) / max(sum(r[f"n{k}"] for r in found), 1) for k in range(p)])
        self.counts = [(sum(r["rows"] for r in found if inside(r, k)), sum(r["deaths"] for r in found if inside(r, k))) for k in range(n)]
        # who starts before every stop is at risk at all of them
        self.starts = bool(found) and not max(r["started"] for r in found) < min(r["stopped"] for r in found)
        self.events = [0] * n
        if id_column:
            per = self.data.groupBy("id").agg(*(F.bit_or(m).alias(m) for m in masks)).groupBy(*masks).agg(F.count("*").alias("ids")).collect()
            self.events = [sum(r["ids"] for r in per if inside(r, k)) for k in range(n)]
        # centred, and not a number where null
        nan = F.lit(math.nan)
        self.rows = self.data.select(*(F.coalesce(F.col(f"x{k}") - float(self.means[k]), nan).alias(f"x{k}") for k in range(p)), *(c for c in self.data.columns[p:] if c != "id"))

    def _round(self, states: list[_State]) -> None:
        """Evaluate all states at their trial points, in one job."""
        picked = [([self.covariates.index(c) for c in s.covariates], s.strata is not None) for s in self.specs]
        groups: dict[tuple, list[_State]] = {}
        for s in states:
            groups.setdefault((s.spec, s.cluster), []).append(s)
        blocks = [(spec, part[i : i + BLOCK]) for (spec, _), part in groups.items() for i in range(0, len(part), BLOCK)]
        shared = self.spark.sparkContext.broadcast((picked, [(spec, [(s.replica, s.cluster, s.trial) for s in part]) for spec, part in blocks], self.seed, self.starts))
        partial = self.rows.mapInArrow(_partial_sums(shared, len(self.covariates)), _PARTIAL)
        added = partial.repartition("block", "stratum", "time").mapInArrow(_add_up, _PARTIAL)
        found = added.repartition("block", "stratum").mapInArrow(_evaluator(shared), "block int, found binary").collect()
        totals: dict[int, np.ndarray] = {}
        for block, values in found:
            totals[block] = totals.get(block, 0) + np.frombuffer(values)
        for number, (spec, part) in enumerate(blocks):
            p = len(picked[spec][0])
            rows = totals.get(number, np.zeros(len(part) * (1 + p + p * p)))
            for s, r in zip(part, rows.reshape(len(part), -1)):
                s.advance(float(r[0]), r[1 : 1 + p].copy(), r[1 + p :].reshape(p, p))
        shared.unpersist()

    def _run(self, states: list[_State], rounds: int) -> None:
        for _ in range(rounds):
            left = [s for s in states if not s.done]
            if not left:
                break
            self._round(left)

    def _state(self, spec: int, replica: int = 0, cluster: int = 0, beta: np.ndarray | None = None) -> _State:
        start = np.zeros(len(self.specs[spec].covariates)) if beta is None else beta
        return _State(spec, replica, cluster, start, start)

    def fits(self, rounds: int = 30) -> dict[str, CoxFit]:
        """One fit per specification, all rows with weight one."""
        states = [self._state(k) for k in range(len(self.specs))]
        self._run(states, rounds)
        out = {}
        for s in states:
            spec = self.specs[s.spec]
            out[spec.name] = CoxFit(list(spec.covariates), s.beta, _inverse(s.info), s.ll, s.null, *self.counts[s.spec], self.events[s.spec], s.converged)
        return out

    def bootstrap(self, replicas: int, fits: dict[str, CoxFit], rounds: int = 30) -> DataFrame:
        """Refits for every specification, cluster column and replica, from the fits' coefficients: (spec, scheme, replica, covariate, coef).

        Replicas that don't converge are left out; their number is what is missing.
        """
        states = [self._state(k, r, c, fits[s.name].beta) for k, s in enumerate(self.specs) for c in range(len(self.clusters)) for r in range(1, replicas + 1)]
        self._run(states, rounds)
        rows = [
            (self.specs[s.spec].name, self.clusters[s.cluster], s.replica, name, float(b))
            for s in states
            if s.converged
            for name, b in zip(self.specs[s.spec].covariates, s.beta)
        ]
        return self.spark.createDataFrame(rows, "spec string, scheme string, replica int, covariate string, coef double")


def cox_fits(rows: DataFrame, specs: list[Spec], stop: str, event: str, start: str | None = None, id_column: str | None = None) -> dict[str, CoxFit]:
    """All specifications over one scan per Newton round."""
    return Table(rows, specs, stop, event, start, id_column=id_column).fits()


def bootstrap_fits(rows: DataFrame, specs: list[Spec], clusters: list[str], replicas: int, stop: str, event: str, start: str | None = None, seed: int = 3) -> DataFrame:
    """Per specification, covariate and cluster column: the fit, the bootstrap's percentile interval and deviation, their
    ratio to the conventional standard error, and whether the interval leaves out a hazard ratio of 1."""
    table = Table(rows, specs, stop, event, start, clusters, seed)
    fits = table.fits()
    drawn = table.bootstrap(replicas, fits)
    conventional = rows.sparkSession.createDataFrame(
        [(name, t[0], float(t[1]), float(t[3])) for name, f in fits.items() for t in f.table()], "spec string, covariate string, coef double, se double"
    )
    q = lambda p: F.exp(F.percentile("coef", F.lit(p)))
    summary = drawn.groupBy("spec", "scheme", "covariate").agg(
        F.count("*").alias("replicas"), F.stddev_samp("coef").alias("se_boot"), q(0.025).alias("low_boot"), q(0.5).alias("hr_boot"), q(0.975).alias("high_boot")
    )
    out = conventional.join(summary, ["spec", "covariate"])
    return out.select(
        "spec", "scheme", "covariate", "coef", F.exp("coef").alias("hr"), "se", "replicas", "se_boot", "low_boot", "hr_boot", "high_boot",
        (F.col("se_boot") / F.col("se")).alias("se_ratio"), ((F.col("low_boot") > 1) | (F.col("high_boot") < 1)).alias("excludes_one"),
    )
