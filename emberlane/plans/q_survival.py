"""Queries of the duration models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import batteries, detector, fits, joins, panel, series, survival
from ..sources.store import stored
from . import q_joins, q_panel
from . import views as v
from .views import entry, table, with_views

_X = ["x1", "x2", "x3"]


def _table(spark, fits):
    return survival.registry(spark, fits)


def _cox(spark, d, covariates=None, **more):
    return survival.cox(v.durations(spark, d), covariates or _X, "t", "e", **more)


def _stops(spark, d):
    return q_panel.start_stop(spark, d).withColumn("risk", F.round("log_n_lag", 4))


def _time_varying(spark, d):
    rows = stored(q_panel.start_stop(spark, d), "start-stop")
    fits = {"tv": (["log_n_lag", "b_lag"], None), "stratified": (["log_n_lag"], "symbol")}
    return _table(spark, {k: survival.cox(rows, c, "stop", "death", start="start", strata=by) for k, (c, by) in fits.items()})


def _logrank(spark, d):
    r = survival.logrank(v.durations(spark, d), "t", "e", "grp")
    return spark.createDataFrame([(float(r["chi2"]), int(r["df"]), float(r["p"]))], "chi2 double, df long, p double")


def _integrated(spark, d):
    """Event steps with every lag, detector state, market covariate, announcement and press label, written once.

    The mean value of a symbol's messages stands for its price.
    """
    dense = stored(v.dense(spark, d), "dense")
    cat = stored(detector.catalog(dense, v.PARAMS), "catalog")
    events = cat.select("event_id", "symbol", "start", "peak", "end", "censored")
    panel_rows = panel.sentiment_panel(events, q_panel.daily(spark, d), 3, 3)
    rows = batteries.wide_start_stop(panel_rows, cat)
    rows = batteries.with_detector_state(rows, detector.detector_daily(cat, dense, v.PARAMS))
    prices = v.messages(spark, d).groupBy("symbol", "step").agg(F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))
    rows = batteries.with_market(rows, panel.price_covariates(events, prices))
    announced = joins.label_announcements(events, q_joins._announcements(spark, d)).select("event_id", "announced")
    press = panel.label_institutional(events, q_panel._press(spark, d)).select("event_id", "label", "echo", "floor", "main")
    rows = rows.join(announced, "event_id", "left").join(press, "event_id", "left")
    return stored(rows.withColumn("era", F.when(F.col("ignition") < 473712, "first").otherwise("last")), "integrated")


_DYNAMIC = ("log_n_lag", "silent_lag", "b_lag", "d_lag")


def _battery(spark, d):
    """M0 to M3, P0 to P2, I1 to I3, lags 1 to 3, eras, without slow events, minimum signal: one scan per step for all."""
    specs = batteries.battery_specs("era", "era = 'first'")
    return _table(spark, fits.cox_fits(_integrated(spark, d), specs, "stop", "death", "start", "event_id"))


def _battery_tests(spark, d):
    """Likelihood ratios of the nested specifications."""
    specs = [s for s in batteries.battery_specs("era", "era = 'first'") if s.name[0] in "MPI"]
    found = fits.cox_fits(_integrated(spark, d), specs, "stop", "death", "start", "event_id")
    pairs = [("M0", "M1"), ("M1", "M2"), ("M2", "M3"), ("P0", "P1"), ("P1", "P2"), ("P2", "I2")]
    return spark.createDataFrame(batteries.likelihood_ratios(found, pairs), "small string, large string, chi2 double, df long, p double, aic_small double, aic_large double")


def _age_table(spark, d):
    """Effects that move with age: log-linear, quadratic, in three bands, one covariate at a time and jointly."""
    rows = stored(batteries.with_age_terms(_integrated(spark, d), ["d_lag", "log_n_lag"], [2, 5]), "ages")
    return _table(spark, fits.cox_fits(rows, batteries.age_specs("d_lag", ("b_lag", "log_n_lag", "silent_lag"), ("d_lag", "log_n_lag"), 3), "stop", "death", "start", "event_id"))


def _age_curve(spark, d):
    return batteries.age_profile(_integrated(spark, d), "d_lag", ("b_lag", "log_n_lag", "silent_lag"), list(range(1, 31)))


def _age_tests(spark, d):
    rows = stored(batteries.with_age_terms(_integrated(spark, d), ["d_lag"]), "ages")
    found = fits.cox_fits(rows, batteries.age_specs("d_lag", ("b_lag", "log_n_lag", "silent_lag")), "stop", "death", "start", "event_id")
    return spark.createDataFrame(batteries.likelihood_ratios(found, [("constant", "log_linear"), ("log_linear", "quadratic")]), "small string, large string, chi2 double, df long, p double, aic_small double, aic_large double")


def _ss_age(spark, d):
    rows = stored(batteries.with_age_terms(q_panel.start_stop(spark, d).withColumn("log_age", F.log("stop")), ["d_lag"], [3]), "durations")
    return _table(spark, fits.cox_fits(rows, [fits.Spec("interaction", ("d_lag", "d_lag_x_age")), fits.Spec("bands", ("d_lag_band0", "d_lag_band1"))], "stop", "death", "start", "event_id"))


def _compare(spark, d):
    rows = v.durations(spark, d)
    found = fits.cox_fits(rows, [fits.Spec("x1", ("x1",)), fits.Spec("all", tuple(_X))], "t", "e")
    r = survival.compare_fits(found["x1"], found["all"])
    return spark.createDataFrame([tuple(map(float, r.values()))], ", ".join(f"{k} double" for k in r))


_RATIO = "fit string, covariate string, ratio double, low double, high double, p double, margin double, inside boolean"


def _wald(spark, d):
    """Hazard ratios of each priority's durations against those of the lowest, with margins of equivalence."""
    specs = [fits.Spec(g, ("x1", "x2"), f"grp = '{g}'") for g in ("5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM")]
    return spark.createDataFrame(batteries.wald_ratios(fits.cox_fits(v.durations(spark, d), specs, "t", "e"), "5-LOW"), _RATIO)


def _median_split(spark, d):
    return _table(spark, batteries.split_by_median(stored(v.durations(spark, d), "durations"), ["x1", "x2"], "t", "e"))


def _robust(spark, d):
    rows = stored(v.durations(spark, d).withColumn("x4", F.col("x1") - 3), "durations")
    fit = survival.cox(rows, ["x1", "x2"], "t", "e")
    cov = survival.robust_covariance(rows, fit, "t", "e", "cluster")
    out = [(n, float(s), float(r)) for n, s, r in zip(fit.covariates, fit.se, np.sqrt(np.diag(cov)))]
    return spark.createDataFrame(out, "covariate string, se double, robust_se double")


def _weibull(spark, d):
    rows = stored(v.durations(spark, d), "durations")
    fit = survival.weibull_aft(rows, ["x1", "x2"], "t", "e")
    base, changes = survival.one_at_a_time(rows, ["x1", "x2"])
    out = [("intercept", fit.intercept), *zip(fit.covariates, map(float, fit.beta)), ("scale", fit.scale), ("median", fit.median([2.0, 4.0]))]
    for age in (0.0, 10.0, 30.0):
        out += [(f"{name}_after_{age:.0f}{side}", x) for name, m, left in fit.scenarios(base, changes, age) for side, x in (("", m), ("_left", left))]
    return spark.createDataFrame(out, "term string, value double")


def _weibull_entry(spark, d):
    rows = v.durations(spark, d).withColumn("entry", F.lit(5.0)).filter("t > 5")
    fit = survival.weibull_aft(rows, ["x1"], "t", "e", entry="entry")
    return spark.createDataFrame([("intercept", fit.intercept), ("x1", float(fit.beta[0])), ("scale", fit.scale)], "term string, value double")


def _ph(spark, d):
    rows = stored(v.durations(spark, d), "durations")
    return spark.createDataFrame(survival.ph_test(rows, survival.cox(rows, _X, "t", "e"), "t", "e"), "covariate string, chi2 double, p double")


def _scored(spark, d):
    rows = stored(v.durations(spark, d), "durations")
    fit = survival.cox(rows, ["x1", "x2"], "t", "e")
    risk = sum((F.col(c) * float(b) for c, b in zip(fit.covariates, fit.beta)), F.lit(0.0))
    return rows.withColumn("risk", risk)


def _calibration(spark, d):
    rows = _scored(spark, d)
    return survival.calibration(rows.withColumn("predicted", F.exp(-0.3 * F.exp("risk"))), "predicted", "t", "e", 30)


#: Populations of V17, as conditions on the integrated table: price shapes, announcements, press.
_SHAPES = {"all": "true", "up20_fall": "ret_max >= 0.2 and ret_peak_to_end < 0", "up10_fall": "ret_max >= 0.1 and ret_peak_to_end < 0", "up20": "ret_max >= 0.2", "other": "not (ret_max >= 0.1 and ret_peak_to_end < 0)"}
_PRESS = {"native": "announced = 0 and label = 'native'", "institutional": "announced = 0 and label = 'institutional'", "announced": "announced = 1"}


def _populations(spark, d):
    """Fits per price shape, announcement and press population, joint models with dummies and interactions, all over one scan;
    and the same of durations by priority."""
    rows = batteries.with_populations(_integrated(spark, d), ("b_lag", "d_lag"), _PRESS, "native")
    rows = survival.standardised(rows, ["log_n_lag"]).withColumnRenamed("log_n_lag_sd", "exposure").withColumn("d_x_exposure", F.col("d_lag") * F.col("exposure"))
    specs = [fits.Spec(f"shape_{k}", _DYNAMIC, c) for k, c in _SHAPES.items()]
    specs += batteries.population_specs(("b_lag", "d_lag"), _PRESS, "native")
    specs += [fits.Spec("exposure", ("b_lag", "d_lag", "exposure", "d_x_exposure"))]
    specs += [fits.Spec(f"{c}_{k}", ("b_lag", "d_lag"), f"announced = 0 and coalesce({c}, false) = {k == 'inside'}") for c in ("echo", "floor", "main") for k in ("inside", "outside")]
    return _table(spark, fits.cox_fits(stored(rows, "populations"), specs, "stop", "death", "start", "event_id"))


def _priorities(spark, d):
    groups = {"low": "grp = '5-LOW'", "urgent": "grp = '1-URGENT'", "high": "grp = '2-HIGH'"}
    rows = batteries.with_populations(v.durations(spark, d), ("x1", "x2"), groups, "low")
    return _table(spark, fits.cox_fits(rows, batteries.population_specs(("x1", "x2"), groups, "low"), "t", "e", id_column="o_orderkey"))


_SIZES = "covariate string, hr double, sd double, hr_sd double, low_sd double, high_sd double, iqr double, hr_iqr double, low_iqr double, high_iqr double, chi2_without double, p_without double"


def _effects(spark, d):
    return spark.createDataFrame(batteries.effect_sizes(stored(v.durations(spark, d), "durations"), _X, "t", "e"), _SIZES)


def _forms(spark, d):
    """The ladder of forms of B without and with D, B by sign, and D on bearish days."""
    rows = batteries.with_forms(_integrated(spark, d))
    return _table(spark, fits.cox_fits(stored(rows, "forms"), batteries.form_specs(("log_n_lag", "silent_lag")), "stop", "death", "start", "event_id"))


def _common(spark, d):
    """One specification on all rows and on the common cohort."""
    specs = [fits.Spec("all", ("x1",)), fits.Spec("common", ("x1",), "year between 1996 and 1999")]
    return _table(spark, fits.cox_fits(v.durations(spark, d), specs, "t", "e", id_column="o_orderkey"))


def _ignitions(spark, d):
    """What is known at ignition, for every event of the catalog."""
    cat = v.catalog(spark, d)
    return cat.select("event_id", F.log1p(F.greatest("z0", F.lit(0.0))).alias("log_z0"), F.log1p(F.greatest("mu0", F.lit(0.0))).alias("log_mu0"), F.col("duration").alias("t"), (~F.col("censored")).cast("int").alias("e"), "start", "principal")


def _ignition_model(spark, d):
    rows = stored(_ignitions(spark, d), "ignitions")
    return batteries.ignition_model(rows, ["log_z0", "log_mu0"], "t", "e", "start", 473900, {"raw": "true", "principal": "principal"}, 500)


def _exclusion(spark, d):
    return batteries.exclusion_auc(stored(_ignitions(spark, d), "ignitions"), ["log_z0", "log_mu0"], "t", "e", "principal")


def _bootstrap_fits(spark, d):
    """Two cluster schemes (customer, quarter of the order), 200 refits each of two specifications, beside conventional errors."""
    rows = v.durations(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.concat_ws("T", F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")).alias("quarter")), "o_orderkey")
    specs = [fits.Spec("short", ("x1", "x2")), fits.Spec("strata", ("x1", "x2"), strata="grp")]
    return fits.bootstrap_fits(rows, specs, ["cluster", "quarter"], 200, "t", "e")


def _daily_probability(spark, d):
    hazard = survival.baseline_hazard(q_panel.start_stop(spark, d), ["log_n_lag"], [0.1], "stop", "death")
    return survival.daily_probability(hazard, {"calm": 0.5, "usual": 1.0, "heated": 2.0})


_SS = q_panel._cat_m(q_panel._SS)

QUERIES = {
    "v1_kaplan_meier": entry(lambda s, d: survival.kaplan_meier(v.durations(s, d), "t", "e", ["grp"]), with_views("dur", """, a as (select grp, t, sum(e) as deaths, count(*) as n from dur group by 1, 2), b as (select grp, t, deaths, sum(n) over (partition by grp order by t desc) as at_risk from a)
        select grp, t, cast(deaths as bigint) as deaths, cast(at_risk as bigint) as at_risk, case when max((deaths >= at_risk)::int) over w = 1 then 0.0 else exp(sum(ln(case when deaths < at_risk then 1 - deaths / at_risk else 1 end)) over w) end as survival from b window w as (partition by grp order by t)"""), "survival"),
    "v1_median": entry(lambda s, d: survival.median_survival(survival.kaplan_meier(v.durations(s, d), "t", "e", ["grp"]), "t", ["grp"]), with_views("dur", """, a as (select grp, t, sum(e) as deaths, count(*) as n from dur group by 1, 2), b as (select grp, t, deaths, sum(n) over (partition by grp order by t desc) as at_risk from a),
        c as (select grp, t, exp(sum(ln(case when deaths < at_risk then 1 - deaths / at_risk else 1e-300 end)) over (partition by grp order by t)) as s from b) select grp, min(t) filter (s <= 0.5) as median from c group by 1""")),
    "v2_logrank": entry(_logrank),
    "v2_logrank_sums": entry(lambda s, d: survival.logrank_sums(v.durations(s, d), "t", "e", "grp"), with_views("dur", """, k as (select t, grp, sum(e) as d, count(*) as n from dur group by 1, 2), g as (select a.t, b.grp, coalesce(k.d, 0) as d, coalesce(k.n, 0) as n from (select distinct t from k) a cross join (select distinct grp from k) b left join k on k.t = a.t and k.grp = b.grp),
        r as (select *, sum(n) over (partition by grp order by t desc) as risk from g), h as (select t, sum(d) / sum(risk) as h from r group by 1) select grp, cast(sum(n) as bigint) as n, cast(sum(d) as bigint) as observed, sum(risk * h) as expected from r join h using (t) group by 1"""), "expected"),
    "v3_cox": entry(lambda s, d: _table(s, {"static": _cox(s, d)})),
    "v4_cox_time_varying": entry(_time_varying),
    "v5_battery": entry(_battery),
    "v5_nested_tests": entry(_battery_tests),
    "v6_age_profile": entry(_age_table),
    "v6_hazard_ratio_curve": entry(_age_curve),
    "v6_age_tests": entry(_age_tests),
    "v6_age_interaction": entry(_ss_age),
    "v7_daily_probability": entry(_daily_probability, _SS + """, hz as (select stop, sum(death) / sum(exp(log_n_lag * 0.1)) as hazard from ss group by 1) select stop, hazard, profile, relative_risk, 1 - exp(-hazard * relative_risk) as probability from hz, (values ('calm', 0.5::double), ('usual', 1.0), ('heated', 2.0)) as x(profile, relative_risk)""", "hazard relative_risk probability"),
    "v8_weibull": entry(_weibull),
    "v8_weibull_entry": entry(_weibull_entry),
    "v9_concordance": entry(lambda s, d: survival.concordance(v.durations(s, d), "x2", "t", "e"), with_views("dur", """, k as (select t, x2, sum(e) as d, count(*) as n from dur group by 1, 2) select cast(sum(a.d * b.n) as bigint) as pairs, sum(a.d * b.n * case when a.x2 > b.x2 then 1.0 when a.x2 = b.x2 then 0.5 else 0 end) / sum(a.d * b.n) as concordance from k a join k b on b.t > a.t"""), "concordance"),
    "v10_concordance_startstop": entry(lambda s, d: survival.concordance_startstop(_stops(s, d), "risk", "stop", "death"), _SS + """, k as (select stop, round(log_n_lag, 4) as risk, death from ss) select count(*) as pairs, avg(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0.0 end) as concordance from k a join k b on a.stop = b.stop and a.death = 1 and b.death = 0""", "concordance"),
    "v11_partial_loglik": entry(lambda s, d: survival.partial_loglik(q_panel.start_stop(s, d), ["log_n_lag", "b_lag"], [0.3, -0.2], "stop", "death"), _SS + """, k as (select stop, sum(death) as d, sum(case when death = 1 then log_n_lag * 0.3 - b_lag * 0.2 end) as x, ln(sum(exp(log_n_lag * 0.3 - b_lag * 0.2))) as s, count(*) as n from ss group by 1)
        select sum(x - d * s) as loglik, sum(-d * ln(n)) as loglik_null, (sum(x - d * s) - sum(-d * ln(n))) / sum(d) as gain_per_death from k where d > 0""", "loglik loglik_null gain_per_death"),
    "v12_compare_fits": entry(_compare),
    "v12_wald_ratios": entry(_wald),
    "v13_ph_test": entry(_ph),
    "v13_split_by_median": entry(_median_split),
    "v14_robust_variance": entry(_robust),
    "v15_temporal_split": entry(lambda s, d: survival.temporal_split(v.catalog(s, d).withColumn("confirmed", F.col("end") + 3), "start", "confirmed", 473700).groupBy("side").agg(F.count("*").alias("n")), with_views("cat", """select case when "end" + 3 < 473700 then 'train' when start >= 473700 then 'test' else 'excluded' end as side, count(*) as n from cat group by 1""")),
    "v16_calibration": entry(_calibration),
    "v17_populations": entry(_populations),
    "v17_priorities": entry(_priorities),
    "v18_effect_sizes": entry(_effects),
    "v18_forms": entry(_forms),
    "v19_risk_table": entry(lambda s, d: survival.risk_table(v.durations(s, d), "t", "e"), with_views("dur", "select t, cast(sum(e) as bigint) as deaths, cast(sum(count(*)) over (order by t desc) as bigint) as at_risk from dur group by 1")),
    "v20_ignition_model": entry(_ignition_model),
    "v20_exclusion_auc": entry(_exclusion),
    "v20_concordance": entry(lambda s, d: survival.concordance(_scored(s, d), "risk", "t", "e")),
    "r1_bootstrap_fits": entry(_bootstrap_fits),
    "v21_spec_registry": entry(_common),
    "v16_risk_terciles": entry(lambda s, d: series.qcut(v.durations(s, d), "x1", 3).groupBy("bin").agg(F.percentile("t", F.lit(0.5)).alias("median_t"), F.count("*").alias("n")), with_views("dur", ", q as (select quantile_cont(x1, 1/3::double) as a, quantile_cont(x1, 2/3::double) as b from dur) select cast(1 + (x1 > a)::int + (x1 > b)::int as bigint) as bin, cast(median(t) as double) as median_t, count(*) as n from dur, q group by 1"), "median_t"),
}
