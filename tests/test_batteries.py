"""What is read off fits, against closed forms, pairs and numeric inversion."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import agreement, batteries, fits, ranks, survival
from emberlane.operators.survival import CoxFit, WeibullFit


def test_hazard_ratio_curve_is_the_quadratic_form():
    v = np.array([[0.04, -0.01, 0.002], [-0.01, 0.09, 0.0], [0.002, 0.0, 0.01]])
    fit = CoxFit(["d", "d_x_age", "z"], np.array([0.5, -0.2, 1.0]), v, 0.0, 0.0, 10, 5)
    for age, hr, low, high in batteries.hazard_ratio_curve(fit, "d", [1, 3, 30]):
        x = math.log(age)
        est, se = 0.5 - 0.2 * x, math.sqrt(0.04 + x * x * 0.09 - 2 * x * 0.01)
        assert (hr, low, high) == pytest.approx((math.exp(est), math.exp(est - 1.96 * se), math.exp(est + 1.96 * se)))


def test_wald_ratios_and_margins():
    one = lambda b, s: CoxFit(["x"], np.array([b]), np.array([[s * s]]), 0.0, 0.0, 1, 1)
    (name, c, ratio, low, high, p, m, inside), *more = batteries.wald_ratios({"ref": one(0.1, 0.03), "other": one(0.3, 0.04)}, "ref", (1.2, 1.5))
    assert (name, c, m) == ("other", "x", 1.2) and ratio == pytest.approx(math.exp(0.2)) and (low, high) == pytest.approx((math.exp(0.2 - 0.098), math.exp(0.2 + 0.098)))
    assert p == pytest.approx(survival.normal_p(4)) and not inside and more[0][-1]


def test_weibull_quantiles_by_numeric_inversion():
    fit = WeibullFit(["a", "b"], 2.0, np.array([0.4, -0.3]), 0.7, 0.0)

    def survives(t, x):
        return math.exp(-((t / math.exp(2.0 + 0.4 * x[0] - 0.3 * x[1])) ** (1 / 0.7)))

    for x in ([0.0, 0.0], [1.5, -2.0]):
        for age in (0.0, 3.0, 25.0):
            for share in (0.5, 0.9):
                lo, hi = age, 1e6
                for _ in range(200):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if survives(mid, x) / survives(age, x) > 1 - share else (lo, mid)
                assert fit.quantile(x, share, age) == pytest.approx(lo, rel=1e-9)
            assert fit.residual_median(x, age) == pytest.approx(fit.quantile(x, 0.5, age) - age)
    rows = fit.scenarios({"a": 1.0, "b": 2.0}, {"same": {}, "up": {"a": 3.0}}, 3.0)
    assert rows[1][1] == pytest.approx(fit.quantile([3.0, 2.0], 0.5, 3.0)) and rows[0][2] == pytest.approx(fit.residual_median([1.0, 2.0], 3.0))


def test_one_at_a_time_profiles(spark):
    rows = spark.createDataFrame([(float(i), float(i % 4)) for i in range(101)], "a double, b double")
    base, changes = survival.one_at_a_time(rows, ["a", "b"])
    assert base == {"a": 50.0, "b": 1.0} and changes["a_low"] == {"a": 25.0} and changes["b_high"] == {"b": 2.0} and changes["median"] == {}


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for e, n in (("a", 6), ("b", 4)):
        for k in range(-2, n):
            rows.append((e, e.upper(), 100 + k, 100, 100 + n - 1, "pre" if k < 0 else "event", k, k + 5, 3 if k % 3 else 0, 1 if k % 3 else 0, 0.1 * k, None if k % 3 == 0 else 0.5))
    return spark.createDataFrame(rows, "event_id string, symbol string, step long, start long, end long, phase string, age long, n long, m_bull long, m_bear long, b double, d double")


def test_wide_table_has_each_lag(spark, panel):
    cat = spark.createDataFrame([("a", False, 100, False, True, 3.0, 2.0, 5.0), ("b", True, 100, True, True, -1.0, 0.0, 0.01)], "event_id string, censored boolean, start long, slow boolean, principal boolean, z0 double, mu0 double, amplitude double")
    rows = {(r.event_id, r.step): r for r in batteries.wide_start_stop(panel, cat).collect()}
    assert len(rows) == 10 and sum(r.death for r in rows.values()) == 1 and rows["a", 105].death == 1
    for (e, step), r in rows.items():
        k = step - 100
        for lag, end in ((1, ""), (2, "2"), (3, "3")):
            past = k - lag
            if past < -2:
                assert r[f"b_lag{end}"] is None and r[f"d_lag{end}"] is None and r[f"silent_lag{end}"] is None
            else:
                assert r[f"b_lag{end}"] == pytest.approx(0.1 * past) and r[f"d_lag{end}"] == 0.5 and r[f"silent_lag{end}"] == (past % 3 == 0)
                assert r[f"log_n_lag{end}"] == pytest.approx(math.log(past + 6)) and r[f"directional_lag{end}"] == (4 if past % 3 else 0)
        assert (r.start, r.stop) == (k, k + 1) and r.log_z0 == pytest.approx(math.log(4) if e == "a" else 0) and r.log_amplitude == pytest.approx(math.log(5 if e == "a" else 0.1))


@pytest.fixture(scope="module")
def durations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)).round(2)
    t = np.ceil(rng.exponential(np.exp(-0.6 * x[:, 0]) * 9)).clip(1, 30).astype(int)
    e = (rng.random(300) < 0.85).astype(int)
    rows = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(t[i]), int(e[i]), i, bool(t[i] > 3)) for i in range(300)], "id int, x1 double, x2 double, t int, e int, start int, kept boolean").cache()
    return x, t, e, rows


def test_effect_sizes_equal_fits_one_by_one(durations):
    x, _, _, rows = durations
    found = {r[0]: r for r in batteries.effect_sizes(rows, ["x1", "x2"], "t", "e")}
    whole, without = survival.cox(rows, ["x1", "x2"], "t", "e"), survival.cox(rows, ["x2"], "t", "e")
    r = found["x1"]
    sd, iqr = x[:, 0].std(ddof=1), np.subtract(*np.quantile(x[:, 0], [0.75, 0.25]))
    b, s = whole.beta[0], whole.se[0]
    assert r[1:6] == pytest.approx((math.exp(b), sd, math.exp(b * sd), math.exp((b - 1.96 * s) * sd), math.exp((b + 1.96 * s) * sd)), rel=1e-6)
    assert r[6:8] == pytest.approx((iqr, math.exp(b * iqr)), rel=1e-6) and r[10] == pytest.approx(2 * (whole.loglik - without.loglik), abs=1e-5)


def test_split_by_median(durations):
    _, t, _, rows = durations
    found = batteries.split_by_median(rows, ["x1"], "t", "e")
    short = survival.cox(rows.filter(F.col("t") <= float(np.median(t))), ["x1"], "t", "e")
    assert np.allclose(found["short"].beta, short.beta, atol=1e-7) and found["short"].rows + found["long"].rows == 300


def pairs_share(risk, t, e):
    first = (t[:, None] < t[None, :]) & (e == 1)[:, None]
    return ((risk[:, None] > risk[None, :]) + 0.5 * (risk[:, None] == risk[None, :]))[first].sum() / first.sum()


def test_ignition_model(durations):
    x, t, e, rows = durations
    got = {r.population: r for r in batteries.ignition_model(rows, ["x1", "x2"], "t", "e", "start", 200, {"raw": "true", "kept": "kept"}, 40).collect()}
    for name, keep in (("raw", t > 0), ("kept", t > 3)):
        order = np.arange(300)
        train, test = keep & (order < 200), keep & (order >= 200)
        fit = survival.cox(rows.filter((F.col("start") < 200) & ((F.lit(name) == "raw") | F.col("kept"))), ["x1", "x2"], "t", "e")
        r = got[name]
        assert r.c_test == pytest.approx(pairs_share((x @ fit.beta)[test], t[test], e[test])) and r.c_train == pytest.approx(pairs_share((x @ fit.beta)[train], t[train], e[train]))
        assert (r.n, r.n_train, r.n_test, r.permutations) == (keep.sum(), train.sum(), test.sum(), 40)
        assert abs(r.placebo_mean - 0.5) < 0.03 and r.p <= 0.05 and r.placebo_p95 < r.c_test
    auc = batteries.exclusion_auc(rows, ["x1", "x2"], "t", "e", "kept").first()
    risk = x @ survival.cox(rows, ["x1", "x2"], "t", "e").beta
    gone, kept = risk[t <= 3], risk[t > 3]
    assert auc.pairs == len(gone) * len(kept) and auc.auc == pytest.approx((gone[:, None] > kept[None, :]).mean())


def test_permutations_deal_every_value_once(durations):
    _, _, _, rows = durations
    got = batteries.permuted(rows, "x1", ["id"], 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.replica, {})[r.id] = r.x1
    want = sorted(r.x1 for r in rows.collect())
    assert len(by) == 5 and all(sorted(d.values()) == want for d in by.values()) and len({tuple(d[i] for i in range(300)) for d in by.values()}) == 5
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(ranks.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_populations_of_one_scan(durations):
    _, _, _, rows = durations
    groups = {"early": "start < 100", "late": "start >= 150"}
    ready = batteries.with_populations(rows, ("x1",), groups, "early")
    found = fits.cox_fits(ready, batteries.population_specs(("x1",), groups, "early"), "t", "e")
    late, early = (survival.cox(rows.filter(c), ["x1"], "t", "e") for c in (groups["late"], groups["early"]))
    assert np.allclose(found["late"].beta, late.beta, atol=1e-6) and np.allclose(found["early"].beta, early.beta, atol=1e-6)
    # a baseline per population and all interactions: the fits of each population
    both = found["stratified"]
    assert both.covariates == ["x1", "x1_x_late"] and np.allclose([both.beta[0], both.beta.sum()], [early.beta[0], late.beta[0]], atol=1e-6)


def test_partial_loglik_of_large_risks(spark):
    rows = spark.createDataFrame([(1, 1, 1990.0), (1, 0, 10.0), (2, 1, 1500.0), (2, 0, 1500.0)], "stop int, d int, x double")
    r = survival.partial_loglik(rows, ["x"], [1.0], "stop", "d").first()
    assert r.loglik == pytest.approx(-math.log(2)) and r.loglik_null == pytest.approx(-2 * math.log(2))


# -- agreement


def test_bootstrap_of_mean_and_median(spark):
    rng = np.random.default_rng(3)
    x = np.append(rng.integers(0, 9, 150).astype(float), rng.normal(4, 2, 90))
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    got = {r.replica: r for r in agreement.bootstrap_values(rows, "x", 300, 3, 8).collect()}
    values, counts = np.unique(x, return_counts=True)
    draws = np.stack([agreement._draws(v, n, 300, 3) for v, n in zip(values.tolist(), counts.tolist())])
    for r in (0, 1, 150, 299):
        sample = np.repeat(values, draws[:, r])
        assert (got[r + 1].mean, got[r + 1].median) == pytest.approx((sample.mean(), np.median(sample)))
    summary = {r.statistic: r for r in agreement.bootstrap_stat(rows, "x", 300).collect()}
    assert summary["median"].low <= np.median(x) <= summary["median"].high and summary["mean"].se == pytest.approx(x.std() / math.sqrt(240), rel=0.15)


def test_exact_p_values():
    for n, k in ((7, 0), (20, 6), (41, 18), (1500, 700)):
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
        assert agreement.binomial_p(k, n) == pytest.approx(want, rel=1e-9)
    # Student's t with 1 and 2 degrees of freedom in closed form
    assert agreement.t_p(2.0, 1) == pytest.approx(1 - 2 * math.atan(2.0) / math.pi) and agreement.t_p(-1.5, 2) == pytest.approx(1 - 1.5 / math.sqrt(2 + 1.5**2))
    ways = [0] * 16
    for signs in range(32):
        ways[sum(k + 1 for k in range(5) if signs >> k & 1)] += 1
    assert agreement.signed_rank_p(13.0, 5, 0) == pytest.approx(2 * sum(ways[13:]) / 32)


def test_paired_tests(spark):
    d = [1.0, -2.0, 3.0, 3.0, 0.0, 5.0, -1.0, 7.0, 8.0, None]
    r = agreement.paired_tests(spark.createDataFrame([(v,) for v in d], "x double"), "x").first()
    assert (r.n, r.n_moved, r.positive, r.negative) == (9, 8, 6, 2) and r.rank_sum == 1.5 + 4.5 + 4.5 + 6 + 7 + 8
    assert r.p_sign == pytest.approx(2 * (1 + 8 + 28) / 256) and 0 < r.p_t < 1 and r.p_rank == pytest.approx(agreement.signed_rank_p(31.5, 8, 12))
    assert agreement.paired_tests(spark.createDataFrame([], "x double"), "x").first().p_sign == 1.0


def test_sign_agreement_and_its_clusters(spark):
    rng = np.random.default_rng(2)
    n = 400
    b = rng.normal(size=n).round(1)
    a = np.where(rng.random(n) < 0.7, b, -b) + 0.0
    size, cluster = rng.integers(1, 6, n), np.arange(n) // 8
    rows = spark.createDataFrame([(float(x), float(y), int(s), int(c)) for x, y, s, c in zip(a, b, size, cluster)], "a double, b double, size int, c int")
    got = {r.threshold: r for r in agreement.sign_agreement(rows, "a", "b", "size", "c", [1, 4], 200).collect()}
    for k in (1, 4):
        keep = (size >= k) & (a != 0) & (b != 0)
        sa, sb, r = a[keep] > 0, b[keep] > 0, got[k]
        po, pe = (sa == sb).mean(), sa.mean() * sb.mean() + (1 - sa.mean()) * (1 - sb.mean())
        assert (r.units, r.both_signed, r.negative_both) == ((size >= k).sum(), keep.sum(), (~sa & ~sb).sum())
        assert (r.observed, r.expected, r.kappa, r["corr"]) == pytest.approx((po, pe, (po - pe) / (1 - pe), np.corrcoef(a[keep], b[keep])[0, 1]))
        assert r.found_of_b == pytest.approx((~sa & ~sb).sum() / (~sb).sum()) and r.kappa_low < r.kappa < r.kappa_high
        # the replicas, cluster by cluster
        keys = np.array([x[0] for x in spark.createDataFrame([(int(c),) for c in cluster[keep]], "c int").select(F.xxhash64("c")).collect()])
        w = fits._weights(keys, list(range(1, 201)), 3)
        t = [(w * m[:, None]).sum(0) for m in (sa & sb, sa & ~sb, ~sa & sb, ~sa & ~sb)]
        m = sum(t)
        o, x, y = (t[0] + t[3]) / m, (t[0] + t[1]) / m, (t[0] + t[2]) / m
        e = x * y + (1 - x) * (1 - y)
        assert (r.kappa_low, r.kappa_high) == pytest.approx(tuple(np.quantile((o - e) / (1 - e), [0.025, 0.975])))


def test_negative_controls_keep_away_from_mentions(spark):
    real = [("s", "A", d) for d in (20, 21, 40)] + [("s", "B", 7), ("t", "A", 100)]
    rows = spark.createDataFrame([(s, y, d, f"{s}{y}{d}") for s, y, d in real], "source string, symbol string, step long, mention_id string")
    span = spark.createDataFrame([(0, 120)], "first long, last long")
    got = agreement.control_mentions(rows, span, times=4).collect()
    count = {}
    for r in got:
        count[r.source, r.symbol] = count.get((r.source, r.symbol), 0) + 1
        assert 0 <= r.step <= 120 and all(abs(r.step - d) > 3 for s, y, d in real if (s, y) == (r.source, r.symbol))
    assert count == {("s", "A"): 12, ("s", "B"): 4, ("t", "A"): 4} and len({(r.source, r.symbol, r.step) for r in got}) == 20
    ignitions = spark.createDataFrame([("A", d) for d in (20, 23, 99)] + [("B", 60)], "symbol string, start long")
    r = {x.source: x for x in agreement.event_study_controls(rows, ignitions, span).collect()}
    assert (r["s"].mentions, r["s"].hits, r["s"].controls) == (4, 2, 4) and (r["t"].hits, r["t"].mentions) == (1, 1)


def test_model_duel_is_on_the_same_rows(durations):
    _, _, _, rows = durations
    some = rows.withColumn("x2", F.when(F.col("id") % 5 > 0, F.col("x2")))
    found = agreement.model_duel(some, ("x1",), ("x2",), (), "t", "e")
    assert found["a"].rows == found["b"].rows == 240 and np.allclose(found["a"].beta, survival.cox(some.filter("x2 is not null"), ["x1"], "t", "e").beta, atol=1e-7)
