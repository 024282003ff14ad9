"""Fits that share scans against single fits and against Efron's likelihood written out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import fits
from emberlane.operators.fits import Spec

COLUMNS = "id int, x1 double, x2 double, start int, stop int, e int, g string, c int, y int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 160
    x = rng.normal(size=(n, 2)).round(2)
    start = rng.integers(0, 3, n)
    stop = start + np.ceil(rng.exponential(np.exp(-0.4 * x[:, 0]) * 5)).clip(1, 15).astype(int)
    return x, start, stop, (rng.random(n) < 0.75).astype(int), rng.integers(0, 3, n), np.arange(n) % 23, rng.integers(2000, 2004, n)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, start, stop, e, g, c, y = data
    return spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(start[i]), int(stop[i]), int(e[i]), f"g{g[i]}", int(c[i]), int(y[i])) for i in range(len(e))], COLUMNS).repartition(5).cache()


def newton(x, start, stop, e, strata=None, weight=None):
    """Efron's model of copied rows, one term after the other."""
    if weight is not None:
        keep = np.repeat(np.arange(len(e)), weight.astype(int))
        x, start, stop, e = x[keep], start[keep], stop[keep], e[keep]
        strata = None if strata is None else strata[keep]
    strata = np.zeros(len(e)) if strata is None else strata
    p = x.shape[1]
    beta = np.zeros(p)
    for _ in range(30):
        ll, grad, info, w = 0.0, np.zeros(p), np.zeros((p, p)), np.exp(x @ beta)
        for s in np.unique(strata):
            for u in np.unique(stop[(e == 1) & (strata == s)]):
                risk, dead = (stop >= u) & (start < u) & (strata == s), (stop == u) & (e == 1) & (strata == s)
                ll += (x[dead] @ beta).sum()
                grad += x[dead].sum(0)
                for k in range(dead.sum()):
                    v = np.where(risk, w, 0) - np.where(dead, w, 0) * k / dead.sum()
                    m = (v[:, None] * x).sum(0) / v.sum()
                    ll -= math.log(v.sum())
                    grad -= m
                    info += np.einsum("i,ij,ik->jk", v, x, x) / v.sum() - np.outer(m, m)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-11:
            break
    return beta, np.linalg.inv(info), ll


def test_specifications_over_one_scan_equal_single_fits(rows, data):
    x, start, stop, e, g, _, y = data
    specs = [Spec("one", ("x1",)), Spec("both", ("x2", "x1")), Spec("late", ("x1", "x2"), "y >= 2002"), Spec("strata", ("x1", "x2"), strata="g"), Spec("some", ("x2",), "c < 10", "y")]
    found = fits.cox_fits(rows, specs, "stop", "e", "start", "id")
    cases = {"one": (x[:, :1], e >= 0, None), "both": (x[:, ::-1], e >= 0, None), "late": (x, y >= 2002, None), "strata": (x, e >= 0, g), "some": (x[:, 1:], data[5] < 10, y)}
    for name, (v, keep, by) in cases.items():
        beta, covariance, ll = newton(v[keep], start[keep], stop[keep], e[keep], None if by is None else by[keep])
        fit = found[name]
        assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.covariance, covariance, rtol=1e-4) and fit.loglik == pytest.approx(ll, abs=1e-5)
        assert (fit.rows, fit.deaths, fit.events, fit.converged) == (keep.sum(), e[keep].sum(), keep.sum(), True)


def test_replicas_equal_refits_one_by_one(spark, rows, data):
    x, start, stop, e, g, c, y = data
    specs = [Spec("plain", ("x1", "x2")), Spec("strata", ("x1",), "y > 2000", "g")]
    table = fits.Table(rows, specs, "stop", "e", "start", ["c", "y"], seed=5)
    replicas = {(r.spec, r.scheme, r.replica, r.covariate): r.coef for r in table.bootstrap(70, table.fits()).collect()}
    # the same weights, from the clusters' hashes
    hashes = {s: np.array([r[0] for r in rows.orderBy("id").select(F.xxhash64(s)).collect()]) for s in ("c", "y")}
    for k, scheme in enumerate(("c", "y")):
        for r in (1, 2, 66, 70):
            w = fits._weights(hashes[scheme], [r], 5 + k)[:, 0]
            beta, _, _ = newton(x, start, stop, e, weight=w)
            got = [replicas.get(("plain", scheme, r, n)) for n in ("x1", "x2")]
            assert got[0] is None or np.allclose(got, beta, atol=1e-6)
            keep = y > 2000
            beta, _, _ = newton(x[keep][:, :1], start[keep], stop[keep], e[keep], g[keep], w[keep])
            assert np.allclose(replicas["strata", scheme, r, "x1"], beta, atol=1e-6)
    assert len({k[2] for k in replicas if k[0] == "plain" and k[1] == "c"}) == 70


def test_weights_are_poisson_and_travel_with_the_cluster():
    c = np.repeat(np.arange(4000, dtype=np.int64) * 7919, 2)
    w = fits._weights(c, list(range(1, 41)), 3)
    assert (w[::2] == w[1::2]).all() and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert (fits._weights(c, [0, 7], 3)[:, 0] == 1).all() and (fits._weights(c, [0, 7], 3)[:, 1] == w[:, 6]).all()


def test_bootstrap_summary(spark):
    """Rows copied three times within clusters: the conventional error is too small by the root of three."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    t = np.ceil(rng.exponential(np.exp(-0.5 * x) * 6)).clip(1, 20)
    rows = spark.createDataFrame([(i, float(x[i]), 0.0, 0, int(t[i]), 1, "a", i, 0) for i in range(300) for _ in range(3)], COLUMNS)
    r = fits.bootstrap_fits(rows, [Spec("m", ("x1",))], ["c"], 120, "stop", "e").first()
    assert r.replicas == 120 and 1.4 < r.se_ratio < 2.1 and r.excludes_one and r.low_boot < r.hr < r.high_boot


def test_nulls_and_empty_specifications(spark, rows):
    more = rows.withColumn("x1", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("x1"))).withColumn("e", F.when(F.col("id") == 3, F.lit(None)).otherwise(F.col("e")))
    specs = [Spec("nulls", ("x1",)), Spec("other", ("x2",)), Spec("nobody", ("x1",), "y > 3000")]
    found = fits.cox_fits(more, specs, "stop", "e", "start")
    whole = fits.cox_fits(more.filter("x1 is not null and e is not null"), specs[:1], "stop", "e", "start")["nulls"]
    assert np.allclose(found["nulls"].beta, whole.beta) and found["nulls"].rows == whole.rows
    assert found["other"].rows == 159 and found["nobody"].rows == 0 and found["nobody"].beta == [0]


def test_one_spec_without_numbers_fails_no_other(spark, rows):
    """information that is no number ended the whole battery with an error."""
    bad = rows.withColumn("x3", F.when(F.col("id") == 5, F.lit(math.inf)).otherwise(F.col("x1")))
    found = fits.cox_fits(bad, [Spec("bad", ("x3",)), Spec("good", ("x1",))], "stop", "e", "start")
    assert found["good"].converged and not found["bad"].converged and math.isnan(found["bad"].se[0])
    state = fits._State(0, 0, beta=np.zeros(1), trial=np.zeros(1))
    state.advance(-10.0, np.ones(1), np.ones((1, 1)))
    for _ in range(20):
        if not state.done:
            state.advance(math.nan, np.full(1, math.nan), np.full((1, 1), math.nan))
    assert state.done and not state.converged and state.beta == [0] and state.ll == -10.0 and state.info == [[1]]


def test_rows_that_start_before_every_stop_need_no_sums_of_starts(spark):
    """One risk set sum per time and death flag: no sums at the common start, and the same fit as with starts of their own."""
    rows = spark.createDataFrame([(i % 7 + 1, int(i % 3 > 0), (i * 37 % 11) / 5, i % 2, 0.0, i % 13) for i in range(300)], "stop int, e int, x double, g int, start double, c int")
    table = fits.Table(rows, [Spec("m", ("x",)), Spec("s", ("x",), "x > 0.3", "g")], "stop", "e", clusters=["c"])
    assert not table.starts
    found = table.fits()
    late = fits.Table(rows.unionByName(rows.limit(1).selectExpr("0.5 as stop", "0 as e", "x", "g", "0.25 as start", "c")), [Spec("m", ("x",)), Spec("s", ("x",), "x > 0.3", "g")], "stop", "e", "start")
    assert not late.starts
    early = fits.Table(rows.unionByName(rows.limit(1).selectExpr("0 as stop", "0 as e", "x", "g", "0.0 as start", "c")), [Spec("m", ("x",))], "stop", "e", "start")
    assert early.starts
    assert early.fits()["m"].beta == pytest.approx(found["m"].beta, abs=1e-9)
    # replicas in one round from one point, and in later ones from their own, are the same fits
    drawn = {(r["spec"], r["replica"]): r["coef"] for r in table.bootstrap(3, found).collect()}
    for r in (1, 2, 3):
        alone = table._state(0, r)
        table._run([alone], 30)
        assert alone.beta[0] == pytest.approx(drawn["m", r], abs=1e-7)
