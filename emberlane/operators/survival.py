"""Duration models. Rows stay in Spark: every iteration is one aggregation that brings sums per time to the driver.

What is collected grows with strata times distinct times (steps of a calendar) and with covariates, not with rows; the
driver's work for a time doesn't grow with its deaths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

# -- tables and curves


def risk_table(rows: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """At each time: at risk, deaths."""
    by = by or []
    per = rows.groupBy(*by, time).agg(F.sum(event).alias("deaths"), F.count("*").alias("_n"))
    later = Window.partitionBy(*by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("at_risk", F.sum("_n").over(later)).drop("_n")


def kaplan_meier(rows: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """V1: the survival curve at each time; 0 from a time at which all at risk die."""
    by = by or []
    up = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max((F.col("deaths") >= F.col("at_risk")).cast("int")).over(up)
    left = F.when(F.col("deaths") < F.col("at_risk"), 1 - F.col("deaths") / F.col("at_risk")).otherwise(1.0)
    return risk_table(rows, time, event, by).withColumn("survival", F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.log(left)).over(up))))


def median_survival(curve: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """V1: the first time at which half or less survive."""
    return curve.groupBy(*(by or [])).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(time))).alias("median"))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square by the series and continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / max(tiny, an * d + b) if abs(an * d + b) > tiny else 1 / tiny
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def safe_exp(x: float) -> float:
    """exp, infinite where a coefficient of separated data runs away."""
    return math.exp(x) if x < 700 else math.inf


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def logrank(rows: DataFrame, time: str, event: str, group: str) -> dict[str, float]:
    """V2: the k-sample test, from counts per time and group."""
    counts = rows.groupBy(time, group).agg(F.sum(event).alias("d"), F.count("*").alias("n")).collect()
    times, groups = sorted({r[0] for r in counts}), sorted({r[1] for r in counts})
    at_t, at_g = {t: i for i, t in enumerate(times)}, {g: i for i, g in enumerate(groups)}
    d, n = np.zeros((len(times), len(groups))), np.zeros((len(times), len(groups)))
    for r in counts:
        d[at_t[r[0]], at_g[r[1]]], n[at_t[r[0]], at_g[r[1]]] = r[2], r[3]
    risk = n[::-1].cumsum(0)[::-1]
    dt, nt = d.sum(1), risk.sum(1)
    gap = (d - risk * (dt / nt)[:, None]).sum(0)[:-1]
    spread = np.where(nt > 1, dt * (nt - dt) / np.maximum(nt - 1, 1), 0)
    share = risk / nt[:, None]
    var = np.diag((spread[:, None] * share).sum(0)) - np.einsum("t,ti,tj->ij", spread, share, share)
    stat = float(gap @ np.linalg.pinv(var[:-1, :-1]) @ gap)
    return {"chi2": stat, "df": len(groups) - 1, "p": chi2_sf(stat, max(1, len(groups) - 1))}


def logrank_sums(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """V2: per group: rows, deaths, and the deaths expected if all groups had the hazard of each time."""
    per = rows.groupBy(time, group).agg(F.sum(event).alias("_d"), F.count("*").alias("_n"))
    later = Window.partitionBy(group).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    # every group at every time: calendar times groups
    grid = per.select(F.col(time).alias("_t")).distinct().join(F.broadcast(per.select(group).distinct()))
    full = grid.join(per.withColumnRenamed(time, "_t"), ["_t", group], "left").na.fill(0, ["_d", "_n"]).withColumn("_risk", F.sum("_n").over(later))
    hazard = full.groupBy("_t").agg((F.sum("_d") / F.sum("_risk")).alias("_h"))
    return full.join(hazard, "_t").groupBy(group).agg(F.sum("_n").alias("n"), F.sum("_d").alias("observed"), F.sum(F.col("_risk") * F.col("_h")).alias("expected"))


# -- Cox


@dataclass
class CoxFit:
    covariates: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    loglik: float
    loglik_null: float
    rows: int
    deaths: int
    events: int = 0
    converged: bool = True

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    def table(self) -> list[tuple]:
        """(covariate, coefficient, hazard ratio, standard error, p, low, high)."""
        out = []
        for name, b, s in zip(self.covariates, self.beta, self.se):
            out.append((name, float(b), safe_exp(b), float(s), normal_p(b / s) if s > 0 else 1.0, safe_exp(b - 1.96 * s), safe_exp(b + 1.96 * s)))
        return out


def _eta(covariates: list[str], beta: np.ndarray):
    total = F.lit(0.0)
    for name, b in zip(covariates, beta):
        total = total + F.col(name) * float(b)
    return total


def _with_parameters(rows: DataFrame, values) -> DataFrame:
    """Rows beside one row of parameters _p0, _p1, ...: as columns, unlike literals, they leave the generated code as it is."""
    row = rows.sparkSession.createDataFrame(pa.table({f"_p{k}": [float(x)] for k, x in enumerate(values)}))
    return rows.crossJoin(F.broadcast(row))


def _sums(rows: DataFrame, covariates: list[str], beta: np.ndarray, weight: str | None, starts: bool = True) -> tuple[list, np.ndarray]:
    """Per stratum and time: sums of w, wx, wxx over rows that stop there and that start there, and over deaths.

    Without ``starts`` all rows start before the first time.
    """
    p = len(covariates)
    rows = _with_parameters(rows, beta)
    w = F.exp(sum((F.col(c) * F.col(f"_p{k}") for k, c in enumerate(covariates)), F.lit(0.0))) * (F.col(weight) if weight else F.lit(1.0))
    rows = rows.withColumn("_w", w)
    dead = F.col("_d") * (F.col(weight) if weight else F.lit(1.0))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    w = F.col("_w")
    moments = [w, *(w * F.col(c) for c in covariates), *(w * F.col(covariates[i]) * F.col(covariates[j]) for i, j in pairs)]
    size = len(moments)
    names = [f"{side}{k}" for side in "abc" for k in range(size)] + ["d", *(f"x{k}" for k in range(p)), "nd"]
    of_stops = dict(zip(names[:size], moments)) | dict(zip(names[2 * size : 3 * size], (m * F.col("_d") for m in moments)))
    of_stops |= {"d": dead, "nd": F.col("_d")} | {f"x{k}": dead * F.col(c) for k, c in enumerate(covariates)}
    of_starts = dict(zip(names[size : 2 * size], moments))

    def per(time: str, found: dict) -> DataFrame:
        return rows.groupBy("_stratum", F.col(time).alias("time")).agg(*((F.sum(found[n]) if n in found else F.lit(0.0)).alias(n) for n in names))

    sums = per("_stop", of_stops)
    if starts:
        sums = sums.unionAll(per("_start", of_starts))
    total: dict[tuple, np.ndarray] = {}
    for r in sums.collect():
        values = np.array([float(v or 0) for v in r[2:]])
        total[r[0], r[1]] = total[r[0], r[1]] + values if (r[0], r[1]) in total else values
    keys = sorted(total)
    return keys, np.array([total[k] for k in keys]).reshape(len(keys), len(names))


def _square(v: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = v
    return out + np.triu(out, 1).T


#: Tied deaths that are added one by one; of more, the last ones are, and those before by an integral with end corrections.
_ONE_BY_ONE = 4096
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _tied(risk: float, dead: float, n: int) -> np.ndarray:
    """Sums over k < n of log s, 1/s, a/s, 1/s2, a/s2, a2/s2 with a = k/n and s = risk - a * dead (Efron's ties)."""

    def terms(k: np.ndarray) -> np.ndarray:
        a = k / n
        s = risk - a * dead
        return np.stack([np.log(s), 1 / s, a / s, 1 / s**2, a / s**2, a**2 / s**2])

    last = max(0, n - _ONE_BY_ONE)
    out = terms(np.arange(last, n, dtype=float)).sum(1)
    if last:
        # panels that shrink towards the end, where s is least
        edges = n - np.geomspace(n, n - last, 40)
        edges[0], edges[-1] = 0, last
        half, middle = np.diff(edges) / 2, (edges[1:] + edges[:-1]) / 2
        nodes = middle[:, None] + half[:, None] * _NODES
        out += terms(nodes.reshape(-1)) @ (half[:, None] * _WEIGHTS).reshape(-1)
        ends = terms(np.array([0.0, last, -0.5, 0.5, last - 0.5, last + 0.5]))
        out += (ends[:, 0] - ends[:, 1]) / 2 + ((ends[:, 5] - ends[:, 4]) - (ends[:, 3] - ends[:, 2])) / 12
    return out


def cox(rows: DataFrame, covariates: list[str], stop: str, event: str, start: str | None = None, strata: str | None = None) -> CoxFit:
    """V3, V4: Cox model with Efron's ties for rows (start, stop]; one row per subject has start 0. See ``fits`` for the steps."""
    from .fits import Spec, cox_fits

    return cox_fits(rows, [Spec("fit", tuple(covariates), strata=strata)], stop, event, start)["fit"]


def robust_covariance(rows: DataFrame, fit: CoxFit, stop: str, event: str, cluster: str) -> np.ndarray:
    """Sandwich variance from score residuals (Breslow's form) summed by cluster; start is 0."""
    c = fit.covariates
    w = F.exp(_eta(c, fit.beta))
    later = Window.orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy(F.col(stop).alias("_t")).agg(F.sum(event).alias("_d"), F.sum(w).alias("_w"), *(F.sum(w * F.col(x)).alias(f"_w{i}") for i, x in enumerate(c)))
    risk = per.select("_t", "_d", F.sum("_w").over(later).alias("_s0"), *(F.sum(f"_w{i}").over(later).alias(f"_s{i + 1}") for i in range(len(c))))
    up = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("_d") / F.col("_s0")
    paths = risk.select("_t", F.sum(h).over(up).alias("_h"), *((F.col(f"_s{i + 1}") / F.col("_s0")).alias(f"_m{i}") for i in range(len(c))), *(F.sum(h * F.col(f"_s{i + 1}") / F.col("_s0")).over(up).alias(f"_q{i}") for i in range(len(c))))
    # one row per time: bounded by the calendar
    joined = rows.join(F.broadcast(paths), rows[stop] == paths["_t"])
    score = [F.col(event) * (F.col(x) - F.col(f"_m{i}")) - w * (F.col(x) * F.col("_h") - F.col(f"_q{i}")) for i, x in enumerate(c)]
    sums = joined.groupBy(cluster).agg(*(F.sum(s).alias(f"u{i}") for i, s in enumerate(score)))
    pairs = [(i, j) for i in range(len(c)) for j in range(i, len(c))]
    meat = sums.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in pairs)).first()
    b = _square(np.array([float(v or 0) for v in meat]), len(c))
    return fit.covariance @ b @ fit.covariance


def partial_loglik(rows: DataFrame, covariates: list[str], beta: list[float], stop: str, event: str) -> DataFrame:
    """Breslow's partial log likelihood of unit intervals with given coefficients, that of none, gain per death."""
    rows = rows.select(stop, event, _eta(covariates, np.array(beta)).alias("_eta"))
    # sums of exponentials are taken under the largest exponent of their time
    top = rows.groupBy(stop).agg(F.max("_eta").alias("_top"))
    moved = rows.join(F.broadcast(top), stop)  # one row per time: bounded by the calendar
    per = moved.groupBy(stop).agg(F.sum(event).alias("d"), F.sum(F.when(F.col(event) == 1, F.col("_eta"))).alias("x"), (F.max("_top") + F.log(F.sum(F.exp(F.col("_eta") - F.col("_top"))))).alias("s"), F.count("*").alias("n")).filter("d > 0")
    ll, null = F.sum(F.col("x") - F.col("d") * F.col("s")), F.sum(-F.col("d") * F.log("n"))
    return per.agg(ll.alias("loglik"), null.alias("loglik_null"), ((ll - null) / F.sum("d")).alias("gain_per_death"))


def concordance_startstop(rows: DataFrame, risk: str, stop: str, event: str) -> DataFrame:
    """At each time, deaths against survivors of that time; ties count half. Counts per risk value, then windows over them."""
    per = rows.groupBy(stop, risk).agg(F.sum(event).alias("d"), F.sum(1 - F.col(event)).alias("s"))
    below = F.coalesce(F.sum("s").over(Window.partitionBy(stop).orderBy(risk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everyone = F.sum("s").over(Window.partitionBy(stop))
    cells = per.select("d", "s", below.alias("below"), everyone.alias("everyone"))
    good, all_pairs = F.sum(F.col("d") * (F.col("below") + F.col("s") / 2)), F.sum(F.col("d") * F.col("everyone"))
    return cells.agg(F.coalesce(all_pairs.cast("long"), F.lit(0)).alias("pairs"), F.try_divide(good, all_pairs).alias("concordance"))


def _ordered_bits(value: str):
    """A double's 64 bits as an integer whose unsigned order is the double's; -0.0 is 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))


#: Rows of a range of risks: what one task counts among themselves, and the bits of their number.
_RANGE, _RANGE_BITS = 1 << 20, 24


def _later(group: np.ndarray, after: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per row of ``of`` (numbers): the sum of ``n`` over the rows of its group with a smaller ``after``."""
    key = group << _RANGE_BITS | after
    order = np.argsort(key, kind="stable")
    key, upto = key[order], np.concatenate([[0], np.cumsum(n[order])])
    first = lambda wanted: upto[np.searchsorted(key, wanted)]
    mine = group[of] << _RANGE_BITS
    return first(mine | after[of]) - first(mine)


def _range_pairs(by: list[str]):
    """In a range of risks: the deaths with a lower risk, and with an equal one, among rows with a longer duration."""

    def count(table: pa.Table) -> pa.Table:
        codes = np.zeros(table.num_rows, np.int64)
        for name in by:
            one = table.column(name).combine_chunks().dictionary_encode()
            codes = codes * len(one.dictionary) + one.indices.to_numpy()
            codes = np.unique(codes, return_inverse=True)[1]
        firsts = np.unique(codes, return_index=True)[1]
        d, n = (table.column(c).to_numpy().astype(np.int64) for c in ("d", "n"))
        after = np.unique(-np.unique(table.column("t").to_numpy(), return_inverse=True)[1], return_inverse=True)[1]
        risk = np.unique(table.column("_o").to_numpy(), return_inverse=True)[1].astype(np.int64)
        good, ties = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        dead = np.flatnonzero(d)
        ties[dead] = d[dead] * _later(np.unique(codes << _RANGE_BITS | risk, return_inverse=True)[1], after, n, dead)
        for bit in range(int(risk.max()).bit_length() if len(risk) else 0):
            # two risks differ first at this bit: the same bits above it, 1 against 0
            high = risk >> bit & 1
            of = np.flatnonzero((high == 1) & (d > 0))
            group = np.unique(codes << _RANGE_BITS | risk >> bit + 1, return_inverse=True)[1]
            good[of] += d[of] * _later(group, after, n * (1 - high), of)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) > 0]))
        sums = [pa.array(np.add.reduceat(x[order], cuts), pa.int64()) for x in (good, ties)]
        return pa.table([*(table.column(name).take(pa.array(firsts)).combine_chunks() for name in by), *sums], names=[*by, "good", "ties"])

    return count


def concordance(rows: DataFrame, risk: str, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """V9: Harrell's C: of pairs whose shorter duration is a death, the share in which it has the higher risk; equal risks count half.

    With ``by`` (replicas, populations) one row for each of its values, all counted together.

    Exact without pairs, from ranges of risks of about a million rows: pairs inside a range are counted by its task, pairs of two
    ranges from the ranges' counts per time, at the first hex digit in which the ranges' numbers differ, with running sums from
    the last time back. A group of running sums has at most one row per time. Rows without a risk or time have no pairs.
    """
    by = by or []
    known = rows.filter(F.col(risk).isNotNull() & F.col(time).isNotNull()).dropna(subset=by) if by else rows.filter(F.col(risk).isNotNull() & F.col(time).isNotNull())
    cells = known.groupBy(*by, F.col(time).alias("t"), (_ordered_bits(risk).bitwiseXOR(F.lit(-(1 << 63)))).alias("_o")).agg(F.sum(event).alias("d"), F.count("*").alias("n"))
    cells = stored(cells, "cells")
    ranges = -(-max(1, cells.count()) // _RANGE)
    placed = stored(cells.repartitionByRange(ranges, *by, "_o").withColumn("_range", F.spark_partition_id()), "ranges")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in cells.select(*by).schema)
    inside = placed.groupBy("_range").applyInArrow(_range_pairs(by), f"{kinds}good long, ties long").groupBy(*by).agg(F.sum("good").alias("_good"), F.sum("ties").alias("ties"))
    per = stored(placed.groupBy(*by, "_range", "t").agg(F.sum("d").alias("d"), F.sum("n").alias("n")), "range-times")
    later = lambda keys, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by, *keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = per.groupBy(*by, "t").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).select(*by, "d", later([], "n").alias("later")).groupBy(*by).agg(F.sum(F.col("d") * F.col("later")).alias("pairs"))
    depth = max(1, -(-(ranges - 1).bit_length() // 4))
    number = F.col("_range").cast("long")
    levels = [F.struct(F.lit(i).alias("level"), F.shiftright(number, 4 * (depth - i)).alias("before"), F.shiftright(number, 4 * (depth - 1 - i)).bitwiseAND(F.lit(15)).alias("digit")) for i in range(depth)]
    long = per.select(*by, "t", "d", "n", F.explode(F.array(*levels)).alias("_l")).select(*by, "t", "d", "n", "_l.*")
    digits = range(16)
    at = lambda c, k: F.sum(F.when(F.col("digit") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    sums = long.groupBy(*by, "level", "before", "t").agg(*(at("d", k) for k in digits), *(at("n", k) for k in digits))
    g = sums.select(*by, *(f"d{k}" for k in digits), *(later(["level", "before"], f"n{k}").alias(f"l{k}") for k in digits))
    below = sum((F.col(f"d{k}") * sum((F.col(f"l{j}") for j in range(k)), F.lit(0)) for k in digits), F.lit(0))
    across = g.groupBy(*by).agg(F.sum(below).alias("_across"))
    both = pairs.join(inside, by).join(across, by) if by else pairs.join(inside).join(across)
    return both.select(*by, F.col("pairs").cast("long").alias("pairs"), F.try_divide(F.col("_good") + F.col("_across") + F.col("ties") / 2, F.col("pairs")).alias("concordance"))


def baseline_hazard(rows: DataFrame, covariates: list[str], beta: list[float], stop: str, event: str) -> DataFrame:
    """V7: Breslow's hazard of each time for unit intervals."""
    w = F.exp(_eta(covariates, np.array(beta)))
    return rows.groupBy(stop).agg((F.sum(event) / F.sum(w)).alias("hazard"))


def daily_probability(hazard: DataFrame, profiles: dict[str, float]) -> DataFrame:
    """V7: the probability of ending on a day, by relative risk of a profile."""
    options = F.explode(F.map_from_arrays(F.array(*map(F.lit, profiles)), F.array(*map(F.lit, profiles.values()))))
    out = hazard.select("*", options.alias("profile", "relative_risk"))
    return out.withColumn("probability", 1 - F.exp(-F.col("hazard") * F.col("relative_risk")))


def compare_fits(small: CoxFit, large: CoxFit) -> dict[str, float]:
    """Likelihood ratio of nested fits, and both AIC."""
    stat, df = 2 * (large.loglik - small.loglik), len(large.beta) - len(small.beta)
    return {"chi2": stat, "df": df, "p": chi2_sf(stat, max(1, df)), "aic_small": 2 * len(small.beta) - 2 * small.loglik, "aic_large": 2 * len(large.beta) - 2 * large.loglik}


def ph_test(rows: DataFrame, fit: CoxFit, stop: str, event: str) -> list[tuple[str, float, float]]:
    """Correlation of scaled Schoenfeld residuals with log time, (covariate, chi-square, p); unit intervals or start 0 alike by risk sets of ``stop``."""
    c, p = fit.covariates, len(fit.covariates)
    data = rows.select(*c, F.col(stop).cast("double").alias("_stop"), F.lit(0.0).alias("_start"), F.col(event).cast("double").alias("_d"), F.lit("").alias("_stratum"))
    keys, m = _sums(data, c, fit.beta, None)
    size = 1 + p + p * (p + 1) // 2
    risk = m[:, :size][::-1].cumsum(0)[::-1]
    d, x = m[:, 3 * size], m[:, 3 * size + 1 : 3 * size + 1 + p]
    with_deaths = d > 0
    times = np.log(np.array([k[1] for k in keys])[with_deaths])
    resid = (x - d[:, None] * risk[:, 1 : 1 + p] / np.maximum(risk[:, :1], 1e-300))[with_deaths]
    g = times - np.average(times, weights=d[with_deaths])
    scaled = d.sum() * resid @ fit.covariance
    top = (g[:, None] * scaled).sum(0) ** 2
    stat = top / (d.sum() * np.diag(fit.covariance) * (d[with_deaths] * g**2).sum())
    return [(name, float(s), chi2_sf(float(s), 1)) for name, s in zip(c, stat)]


# -- Weibull


@dataclass
class WeibullFit:
    covariates: list[str]
    intercept: float
    beta: np.ndarray
    scale: float
    loglik: float

    def median(self, x: list[float]) -> float:
        return self.quantile(x, 0.5)

    def quantile(self, x: list[float], share: float, age: float = 0.0) -> float:
        """The time by which ``share`` of those that survive to ``age`` are gone."""
        centre = math.exp(self.intercept + float(np.dot(self.beta, x)))
        past = (age / centre) ** (1 / self.scale) if age > 0 else 0.0
        return centre * (past - math.log1p(-share)) ** self.scale

    def residual_median(self, x: list[float], age: float) -> float:
        """The median of what is left after ``age``."""
        return self.quantile(x, 0.5, age) - age

    def scenarios(self, base: dict[str, float], changes: dict[str, dict[str, float]], age: float = 0.0) -> list[tuple[str, float, float]]:
        """(name, median duration given survival to ``age``, median of what is left), for profiles that differ from the base in some covariates."""
        out = []
        for name, change in changes.items():
            x = [(base | change)[c] for c in self.covariates]
            out.append((name, self.quantile(x, 0.5, age), self.residual_median(x, age)))
        return out


def one_at_a_time(rows: DataFrame, covariates: list[str], shares: tuple[float, float] = (0.25, 0.75)) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """V8: the median profile, and for each covariate the profiles with it alone at its lower and upper quantile."""
    got = rows.agg(*(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.5), *map(F.lit, shares))) for c in covariates)).first()
    base = {c: float(q[0]) for c, q in zip(covariates, got)}
    changes = {"median": {}}
    for c, q in zip(covariates, got):
        changes |= {f"{c}_low": {c: float(q[1])}, f"{c}_high": {c: float(q[2])}}
    return base, changes


def _least_squares(data: DataFrame, names: list[str]) -> np.ndarray:
    """A start for the Weibull model: least squares of log times, moved and scaled as the errors' distribution asks."""
    q = len(names)
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    sums = data.agg(*(F.avg(F.col(names[i]) * F.col(names[j])) for i, j in pairs), *(F.avg(F.col(n) * F.col("_t")) for n in names), F.avg(F.col("_t") ** 2)).first()
    sums = np.array([float(v or 0) for v in sums])
    right = sums[len(pairs) : -1]
    beta = np.linalg.pinv(_square(sums[: len(pairs)], q)) @ right
    scale = math.sqrt(max(sums[-1] - float(beta @ right), 1e-6) * 6) / math.pi
    beta[0] += np.euler_gamma * scale
    return np.append(beta, math.log(scale))


def weibull_aft(rows: DataFrame, covariates: list[str], time: str, event: str, entry: str | None = None, rounds: int = 60) -> WeibullFit:
    """V8: accelerated failure times with Weibull errors, right-censored and optionally left-truncated, by damped Newton steps."""
    names = ["_one", *covariates]
    q = len(names)
    data = rows.select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double") for c in covariates), F.log(F.col(time).cast("double")).alias("_t"), F.col(event).cast("double").alias("_d"), (F.log(F.greatest(F.col(entry).cast("double"), F.lit(1e-9))) if entry else F.lit(None).cast("double")).alias("_e"))
    data = stored(data, "weibull")
    theta = _least_squares(data, names)

    def evaluate(th: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s, log_s = F.exp(F.col(f"_p{q}")), F.col(f"_p{q}")
        eta = sum((F.col(n) * F.col(f"_p{k}") for k, n in enumerate(names)), F.lit(0.0))
        z, z0 = (F.col("_t") - eta) / s, (F.col("_e") - eta) / s
        v = _with_parameters(data, th).withColumn("_z", z).withColumn("_u", F.exp("_z")).withColumn("_z0", F.coalesce(z0, F.lit(0.0))).withColumn("_u0", F.when(F.col("_e").isNull(), 0.0).otherwise(F.exp("_z0")))
        r = F.col("_u") - F.col("_d") - F.col("_u0")
        zu, zu0 = F.col("_z") * F.col("_u"), F.col("_z0") * F.col("_u0")
        pairs = [(i, j) for i in range(q) for j in range(i, q)]
        got = v.agg(
            F.sum(F.col("_d") * (F.col("_z") - log_s - F.col("_t")) - F.col("_u") + F.col("_u0")),
            *(F.sum(F.col(n) * r / s) for n in names),
            F.sum(F.col("_d") * (-F.col("_z") - 1) + zu - zu0),
            *(F.sum(-F.col(names[i]) * F.col(names[j]) * (F.col("_u") - F.col("_u0")) / s**2) for i, j in pairs),
            *(F.sum(-F.col(n) * (r + zu - zu0) / s) for n in names),
            F.sum(F.col("_d") * F.col("_z") - zu * (1 + F.col("_z")) + zu0 * (1 + F.col("_z0"))),
        ).first()
        got = [float(x or 0) for x in got]
        k = len(pairs)
        hess = np.zeros((q + 1, q + 1))
        hess[:q, :q] = _square(np.array(got[2 + q : 2 + q + k]), q)
        hess[:q, q] = hess[q, :q] = got[2 + q + k : 2 + 2 * q + k]
        hess[q, q] = got[-1]
        return got[0], np.array(got[1 : 2 + q]), hess

    ll, grad, hess = evaluate(theta)
    for _ in range(rounds):
        damp = 0.0
        while True:
            info = -hess + damp * np.eye(q + 1)
            if np.linalg.eigvalsh(info)[0] > 1e-9:
                step = np.linalg.solve(info, grad)
                step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
                new = evaluate(theta + step)
                if new[0] >= ll - 1e-10:
                    break
            damp = max(1e-3, damp * 4)
            if damp > 1e12:
                new, step = (ll, grad, hess), np.zeros(q + 1)
                break
        theta, gain = theta + step, new[0] - ll
        ll, grad, hess = new
        if abs(gain) < 1e-9 * (1 + abs(ll)):
            break
        if np.linalg.eigvalsh(-hess)[0] > 1e-9:
            last = np.linalg.solve(-hess, grad)
            if float(grad @ last) < 1e-8 * (1 + abs(ll)) * 1e-2:
                # what is left is of second order in this step
                theta, ll = theta + last, ll + float(grad @ last) / 2
                break
    return WeibullFit(covariates, float(theta[0]), theta[1:-1], float(np.exp(theta[-1])), ll)


# -- designs around the fits


def temporal_split(rows: DataFrame, start: str, confirmed: str, cut: int) -> DataFrame:
    """Confirmed before the cut trains, ignited after it tests, anything between is excluded."""
    side = F.when(F.col(confirmed) < cut, "train").when(F.col(start) >= cut, "test").otherwise("excluded")
    return rows.withColumn("side", side)


def calibration(rows: DataFrame, predicted: str, time: str, event: str, horizon: float) -> DataFrame:
    """Predicted and observed survival past a horizon by decile of prediction, with Brier's score; censored before it are left out."""
    from .series import qcut

    known = rows.filter((F.col(time) > horizon) | (F.col(event) == 1)).withColumn("_y", (F.col(time) > horizon).cast("double"))
    return qcut(known, predicted, 10).groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("predicted"), F.avg("_y").alias("observed"), F.avg((F.col(predicted) - F.col("_y")) ** 2).alias("brier"))


def standardised(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """Covariates in units of their standard deviation, as <name>_sd."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in covariates), *(F.stddev_samp(c).alias(f"_s_{c}") for c in covariates))
    out = rows.join(F.broadcast(stats))
    for c in covariates:
        out = out.withColumn(f"{c}_sd", F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*(f"_{k}_{c}" for c in covariates for k in "ms"))


def registry(spark, fits: dict[str, CoxFit]) -> DataFrame:
    """One row per specification and covariate."""
    rows = [(name, f.rows, f.events, f.deaths, float(f.loglik), *map(_plain, t)) for name, f in fits.items() for t in f.table()]
    return spark.createDataFrame(rows, "spec string, rows long, events long, deaths long, loglik double, covariate string, coef double, hr double, se double, p double, low double, high double")


def _plain(v):
    return v if isinstance(v, str) else float(v)
