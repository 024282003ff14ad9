from __future__ import annotations

import math

import numpy as np
import pytest

from emberlane.operators import survival


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2)).round(2)
    t = np.ceil(rng.exponential(np.exp(-0.5 * x[:, 0]) * 8)).clip(1, 20).astype(int)
    e = (rng.random(120) < 0.8).astype(int)
    return x, t, e


@pytest.fixture(scope="module")
def rows(spark, data):
    x, t, e = data
    return spark.createDataFrame([(float(a), float(b), int(c), int(d), i % 7) for i, ((a, b), c, d) in enumerate(zip(x, t, e))], "x1 double, x2 double, t int, e int, c int").cache()


def efron(x, start, t, e, beta):
    ll, grad, info = 0.0, np.zeros(2), np.zeros((2, 2))
    w = np.exp(x @ beta)
    for u in np.unique(t[e == 1]):
        risk, dead = (t >= u) & (start < u), (t == u) & (e == 1)
        grad += x[dead].sum(0)
        ll += (x[dead] @ beta).sum()
        n = dead.sum()
        for k in range(n):
            weight = np.where(risk, w, 0) - np.where(dead, w, 0) * k / n
            s0, s1 = weight.sum(), (weight[:, None] * x).sum(0)
            ll -= math.log(s0)
            grad -= s1 / s0
            info += (weight[:, None, None] * np.einsum("ij,ik->ijk", x, x)).sum(0) / s0 - np.outer(s1, s1) / s0**2
    return ll, grad, info


def test_cox_is_at_the_optimum(rows, data):
    x, t, e = data
    fit = survival.cox(rows, ["x1", "x2"], "t", "e")
    ll, grad, info = efron(x, np.zeros(len(t)), t, e, fit.beta)
    assert np.abs(grad).max() < 1e-5
    assert np.allclose(fit.covariance, np.linalg.inv(info), rtol=1e-5)


def test_a_million_tied_deaths():
    """The sums of Efron's ties against adding the terms one by one, also when all at risk die."""
    for n, risk, dead in ((5, 9.0, 4.0), (5000, 9000.0, 5000.0), (1_000_000, 3e6, 1e6), (1_000_000, 1e6, 1e6), (300_000, 2.0, 1.9)):
        a = np.arange(n) / n
        s = risk - a * dead
        want = [np.log(s).sum(), (1 / s).sum(), (a / s).sum(), (1 / s**2).sum(), (a / s**2).sum(), (a**2 / s**2).sum()]
        assert np.allclose(survival._tied(risk, dead, n), want, rtol=1e-9)


def test_cox_with_start_stop(spark, data):
    x, t, e = data
    parts = [(*map(float, x[i]), s, s + 1, int(e[i] and s + 1 == t[i])) for i in range(len(t)) for s in range(t[i])]
    df = spark.createDataFrame(parts, "x1 double, x2 double, start int, stop int, d int")
    whole = survival.cox(spark.createDataFrame([(*map(float, a), int(b), int(c)) for a, b, c in zip(x, t, e)], "x1 double, x2 double, t int, e int"), ["x1", "x2"], "t", "e")
    assert np.allclose(survival.cox(df, ["x1", "x2"], "stop", "d", start="start").beta, whole.beta, atol=1e-6)


def test_kaplan_meier(rows, data):
    _, t, e = data
    s, want = 1.0, {}
    for u in np.unique(t):
        s *= 1 - ((t == u) & (e == 1)).sum() / (t >= u).sum()
        want[int(u)] = s
    got = {r["t"]: r["survival"] for r in survival.kaplan_meier(rows, "t", "e").collect()}
    assert got == pytest.approx(want)
    curve = [got[k] for k in sorted(got)]
    assert curve == sorted(curve, reverse=True)


def test_concordance_against_pairs(rows, data):
    x, t, e = data
    good = pairs = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and t[i] < t[j]:
                pairs += 1
                good += 1 if x[i, 0] > x[j, 0] else 0.5 if x[i, 0] == x[j, 0] else 0
    r = survival.concordance(rows, "x1", "t", "e").first()
    assert r["pairs"] == pairs and r["concordance"] == pytest.approx(good / pairs, abs=1e-12)


def test_logrank_two_groups(rows, data):
    _, t, e = data
    g = np.arange(len(t)) % 7 < 3
    o = v = 0.0
    for u in np.unique(t[e == 1]):
        n, n1, d = (t >= u).sum(), ((t >= u) & g).sum(), ((t == u) & (e == 1)).sum()
        o += ((t == u) & (e == 1) & g).sum() - d * n1 / n
        v += d * (n - d) / max(1, n - 1) * n1 / n * (1 - n1 / n) if n > 1 else 0
    got = survival.logrank(rows.selectExpr("t", "e", "c < 3 as g"), "t", "e", "g")
    assert got["chi2"] == pytest.approx(o * o / v)
    assert survival.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_weibull_gradient_is_zero(rows, data):
    x, t, e = data
    fit = survival.weibull_aft(rows, ["x1"], "t", "e")

    def ll(b0, b1, log_s):
        z = (np.log(t) - b0 - b1 * x[:, 0]) / math.exp(log_s)
        return (e * (z - log_s - np.log(t)) - np.exp(z)).sum()

    at = (fit.intercept, float(fit.beta[0]), math.log(fit.scale))
    assert fit.loglik == pytest.approx(ll(*at))
    for k in range(3):
        up, down = list(at), list(at)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs(ll(*up) - ll(*down)) / 2e-4 < 1e-2


def test_robust_variance_is_close_to_the_model_without_clusters(rows):
    fit = survival.cox(rows.withColumn("id", rows["x1"] * 1000 + rows["x2"]), ["x1", "x2"], "t", "e")
    cov = survival.robust_covariance(rows.withColumn("id", rows["x1"] * 1000 + rows["x2"]), fit, "t", "e", "id")
    assert np.all(np.sqrt(np.diag(cov)) / fit.se > 0.5) and np.all(np.sqrt(np.diag(cov)) / fit.se < 2)


def test_concordance_of_continuous_risks_is_exact(spark):
    rng = np.random.default_rng(8)
    x = np.append(rng.normal(size=1500) * 10.0 ** rng.integers(-6, 6, 1500), [0.0, -0.0, 1.0, 1.0, 1.0])
    t, e = rng.integers(1, 30, len(x)), rng.random(len(x)) < 0.7
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(x, t, e)], "x double, t int, e int")
    pair = (t[:, None] < t[None, :]) & e[:, None]
    good = (pair & (x[:, None] > x[None, :])).sum() + (pair & (x[:, None] == x[None, :])).sum() / 2
    r = survival.concordance(df, "x", "t", "e").first()
    assert r["pairs"] == pair.sum() and r["concordance"] == pytest.approx(good / pair.sum(), abs=1e-12)


def test_concordance_over_ranges_is_that_of_pairs(spark, monkeypatch):
    """Inside ranges of risks, and of different ones, by replica: against all pairs."""
    monkeypatch.setattr(survival, "_RANGE", 8)
    data = [(i % 3, (i * 31 % 17) / 4 - 2, i * 7 % 11, int(i % 4 > 0)) for i in range(240)] + [(0, float(i), 100 + i % 5, 1) for i in range(20)] + [(1, -0.0, 3, 1), (1, 0.0, 9, 0), (2, None, 1, 1), (None, 1.0, 1, 1)]
    df = spark.createDataFrame(data, "g int, x double, t int, e int")
    found = {r["g"]: (r["pairs"], r["concordance"]) for r in survival.concordance(df, "x", "t", "e", ["g"]).collect()}
    whole = survival.concordance(df, "x", "t", "e").first()

    def pairs(rows):
        known = [r for r in rows if r[1] is not None]
        both = [(a[1], b[1]) for a in known for b in known if a[3] and a[2] < b[2]]
        return len(both), pytest.approx(sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in both) / len(both))

    assert found == {g: pairs([r for r in data if r[0] == g]) for g in (0, 1, 2)}
    assert (whole["pairs"], whole["concordance"]) == pairs(data)
    plan = survival.concordance(df, "x", "t", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert "_k" not in plan


def test_durations_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    """More lines make more parts, not larger ones."""
    from emberlane.plans import views

    folder = "/root/testdata/sf0.001"
    want = sorted(views.durations(spark, folder).collect())
    monkeypatch.setattr(views, "LINES", 500)
    rows = views.durations(spark, folder)
    assert rows.rdd.getNumPartitions() >= views.table(spark, folder, "lineitem").count() / 500
    assert sorted(rows.collect()) == want
