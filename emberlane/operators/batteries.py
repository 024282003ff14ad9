"""Batteries of duration models: one wide table of event steps, specifications over it, and what is read off the fits.

The wide table has every lag, detector state and event attribute as a column, so that a specification is a list of columns
and a condition (``fits.Spec``) and all of them share a scan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import survival
from .fits import Spec, Table, cox_fits
from .ranks import bijection, numbered, numbered_median
from .series import detector_covariates, qcut
from .survival import CoxFit, chi2_sf, normal_p, safe_exp

ENTRY = ("log_z0", "log_mu0")
VOLUME = ("log_n_lag",)
DETECTOR = ("log_change_lag", "log_to_threshold_lag", "log_to_peak_lag", "below_lag")
STANCE = ("b_lag", "d_lag", "silent_lag")
REALISED = ("log_amplitude", "log_volume_ratio", "ret_to_peak", "decoupled")


def wide_start_stop(panel: DataFrame, catalog: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Unit intervals (start, stop] of event steps with the panel's state of each lag; lag 1 has plain names, others a number.

    A lag before the panel's first step is null, silence is a disagreement of 0.5 with a dummy.
    """
    w = Window.partitionBy("event_id").orderBy("step")
    columns = []
    for k in lags:
        end = "" if k == 1 else str(k)
        there = F.lag("step", k).over(w).isNotNull()
        columns += [
            F.lag("b", k).over(w).alias(f"b_lag{end}"),
            F.when(there, F.coalesce(F.lag("d", k).over(w), F.lit(0.5))).alias(f"d_lag{end}"),
            F.when(there, F.lag("d", k).over(w).isNull().cast("int")).alias(f"silent_lag{end}"),
            F.log1p(F.lag("n", k).over(w)).alias(f"log_n_lag{end}"),
            (F.lag("m_bull", k).over(w) + F.lag("m_bear", k).over(w)).alias(f"directional_lag{end}"),
        ]
    steps = panel.select("event_id", "symbol", "step", "phase", "age", "end", *columns).filter("phase = 'event'")
    known = catalog.select("event_id", "censored", F.col("start").alias("ignition"), "slow", "principal", F.log1p(F.greatest("z0", F.lit(0.0))).alias("log_z0"), F.log1p(F.greatest("mu0", F.lit(0.0))).alias("log_mu0"), F.log(F.greatest("amplitude", F.lit(0.1))).alias("log_amplitude"))
    death = ((F.col("step") == F.col("end")) & ~F.col("censored")).cast("int")
    out = steps.join(known, "event_id").withColumns({"start": F.col("age"), "stop": F.col("age") + 1, "death": death, "log_age": F.log(F.col("age") + 1)})
    return out.drop("phase", "age", "end", "censored")


def with_detector_state(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """The detector's state of the step before: log change, log ratios to threshold and running peak, steps below."""
    lagged = detector_covariates(daily)
    below = daily.select("event_id", (F.col("step") + 1).alias("step"), F.col("below").alias("below_lag"))
    state = lagged.join(below, ["event_id", "step"], "left").select(
        "event_id", "step", F.coalesce("log_change_lag", F.when(F.col("to_peak_lag").isNotNull(), 0.0)).alias("log_change_lag"),
        F.log(F.greatest("to_threshold_lag", F.lit(1e-3))).alias("log_to_threshold_lag"), F.log(F.greatest("to_peak_lag", F.lit(1e-3))).alias("log_to_peak_lag"), "below_lag",
    )
    return rows.join(state, ["event_id", "step"], "left")


def with_market(rows: DataFrame, covariates: DataFrame) -> DataFrame:
    """P2's covariates of the event: volume ratio and return to the peak, decoupled (price peak over two steps away or unknown), price shapes."""
    c = covariates.select(
        "event_id", F.log(F.greatest("volume_ratio", F.lit(0.1))).alias("log_volume_ratio"), "ret_to_peak", "ret_peak_to_end", "ret_max",
        F.coalesce((F.abs("price_lag") > 2).cast("int"), F.lit(1)).alias("decoupled"),
    )
    return rows.join(c, "event_id", "left")


def battery_specs(strata: str = "era", era_cut: str = "true", least_signal: int = 5) -> list[Spec]:
    """V5: nested M0 to M3, P0 to P2, I1 to I3, lags 1 to 3, eras, without slow events, minimum signal."""
    dynamic = ("log_n_lag", "silent_lag", "b_lag", "d_lag")
    known = " and ".join(f"{c} is not null" for c in DETECTOR)
    whole = " and ".join(f"{c} is not null" for c in REALISED)
    nested = [ENTRY, ENTRY + VOLUME, ENTRY + VOLUME + DETECTOR, ENTRY + VOLUME + DETECTOR + STANCE]
    specs = [Spec(f"M{k}", c, f"start >= 1 and {known}") for k, c in enumerate(nested)]
    specs += [Spec("P0", ("log_n_lag", *ENTRY), whole), Spec("P1", ("log_n_lag", "silent_lag", *ENTRY), whole), Spec("P2", dynamic + ENTRY, whole)]
    specs += [Spec("I1", dynamic + ENTRY), Spec("I2", dynamic + ENTRY + REALISED), Spec("I3", dynamic + ENTRY + REALISED, strata=strata)]
    lag = lambda k: tuple(f"{c}{'' if k == 1 else k}" for c in dynamic)
    specs += [Spec(f"lag{k}", lag(k)) for k in (1, 2, 3)]
    specs += [Spec("era_first", dynamic, era_cut), Spec("era_last", dynamic, f"not ({era_cut})"), Spec("by_era", dynamic, strata=strata)]
    return specs + [Spec("no_slow", dynamic, "not slow"), Spec("signal", ("b_lag", "d_lag", "log_n_lag"), f"directional_lag >= {least_signal}")]


def population_specs(covariates: tuple[str, ...], groups: dict[str, str], reference: str) -> list[Spec]:
    """A fit in each population (name to SQL condition), dummies with a common baseline, all interactions with it, and
    all interactions with a baseline per population. Needs the columns of ``with_populations``."""
    others = [g for g in groups if g != reference]
    dummies, crossed = tuple(f"g_{g}" for g in others), tuple(f"{c}_x_{g}" for g in others for c in covariates)
    some = "population is not null"
    return [
        *(Spec(g, covariates, f"population = '{g}'") for g in groups),
        Spec("dummies", covariates + dummies, some),
        Spec("interacted", covariates + dummies + crossed, some),
        Spec("stratified", covariates + crossed, some, "population"),
    ]


def with_populations(rows: DataFrame, covariates: tuple[str, ...], groups: dict[str, str], reference: str) -> DataFrame:
    """The first population whose condition holds, dummies for all but the reference, and covariates times dummies."""
    label = F.coalesce(*(F.when(F.expr(c), g) for g, c in groups.items()))
    out = rows.withColumn("population", label)
    for g in groups:
        if g != reference:
            is_g = (F.col("population") == g).cast("int")
            out = out.withColumns({f"g_{g}": is_g} | {f"{c}_x_{g}": F.col(c) * is_g for c in covariates})
    return out


def wald_ratios(fits: dict[str, CoxFit], reference: str, margins: tuple[float, ...] = (1.25, 1.5, 2.0)) -> list[tuple]:
    """Ratios of hazard ratios of independent fits to the reference's, (fit, covariate, ratio, low, high, p, margin, inside)."""
    base, out = fits[reference], []
    for name, fit in fits.items():
        if name == reference:
            continue
        for c in fit.covariates:
            if c in base.covariates:
                i, j = fit.covariates.index(c), base.covariates.index(c)
                gap, se = float(fit.beta[i] - base.beta[j]), math.hypot(float(fit.se[i]), float(base.se[j]))
                low, high = safe_exp(gap - 1.96 * se), safe_exp(gap + 1.96 * se)
                out += [(name, c, safe_exp(gap), low, high, normal_p(gap / se) if se > 0 else 1.0, float(m), low > 1 / m and high < m) for m in margins]
    return out


def likelihood_ratios(fits: dict[str, CoxFit], pairs: list[tuple[str, str]]) -> list[tuple]:
    """(small, large, chi-square, degrees of freedom, p, AIC of small, AIC of large) for nested fits of the same rows."""
    out = []
    for small, large in pairs:
        r = survival.compare_fits(fits[small], fits[large])
        out.append((small, large, float(r["chi2"]), int(r["df"]), float(r["p"]), float(r["aic_small"]), float(r["aic_large"])))
    return out


def combined(fit: CoxFit, weights: dict[str, float]) -> tuple[float, float]:
    """A linear combination of coefficients and its standard error, by the quadratic form of their covariance."""
    l = np.array([weights.get(c, 0.0) for c in fit.covariates])
    return float(l @ fit.beta), math.sqrt(max(float(l @ fit.covariance @ l), 0.0))


# -- V6


def with_age_terms(rows: DataFrame, covariates: list[str], bands: list[int] = (), age: str = "log_age", stop: str = "stop") -> DataFrame:
    """Covariates times log age (_x_age) and its square (_x_age2), and covariates within age bands (_band0, ...)."""
    out = rows
    for c in covariates:
        out = out.withColumns({f"{c}_x_age": F.col(c) * F.col(age), f"{c}_x_age2": F.col(c) * F.col(age) ** 2})
        edges = [None, *bands, None]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if len(bands) else []:
            inside = (F.lit(True) if lo is None else F.col(stop) > lo) & (F.lit(True) if hi is None else F.col(stop) <= hi)
            out = out.withColumn(f"{c}_band{k}", F.when(inside, F.col(c)).otherwise(0.0 * F.col(c)))
    return out


def age_specs(covariate: str, others: tuple[str, ...], moving: tuple[str, ...] = (), n_bands: int = 0) -> list[Spec]:
    """V6: constant, log-linear and quadratic effect of age on one covariate, effects by band, and all moving ones jointly."""
    specs = [Spec("constant", (covariate, *others)), Spec("log_linear", (covariate, f"{covariate}_x_age", *others)), Spec("quadratic", (covariate, f"{covariate}_x_age", f"{covariate}_x_age2", *others))]
    if n_bands:
        specs.append(Spec("bands", (*(f"{covariate}_band{k}" for k in range(n_bands)), *others)))
    specs += [Spec(f"one_{c}", (covariate, *others, f"{c}_x_age")) for c in moving if c != covariate]
    return specs + ([Spec("joint", (covariate, *others, *(f"{c}_x_age" for c in moving)))] if moving else [])


def hazard_ratio_curve(fit: CoxFit, covariate: str, ages: list[float]) -> list[tuple]:
    """V6: (age, hazard ratio, low, high) of one unit of a covariate, with bands by the delta method."""
    out = []
    for age in ages:
        x = math.log(age)
        est, se = combined(fit, {covariate: 1.0, f"{covariate}_x_age": x, f"{covariate}_x_age2": x * x})
        out.append((float(age), safe_exp(est), safe_exp(est - 1.96 * se), safe_exp(est + 1.96 * se)))
    return out


def age_profile(rows: DataFrame, covariate: str, others: tuple[str, ...], ages: list[int], form: str = "log_linear", stop: str = "stop", event: str = "death", start: str = "start", fits: dict[str, CoxFit] | None = None) -> DataFrame:
    """V6: HR(t) with bands beside the risk table, and whether an age lies before the first death."""
    ready = with_age_terms(rows, [covariate])
    fits = fits or cox_fits(ready, age_specs(covariate, others), stop, event, start)
    curve = rows.sparkSession.createDataFrame(hazard_ratio_curve(fits[form], covariate, ages), "age double, hr double, low double, high double")
    per = rows.groupBy(F.col(stop).cast("double").alias("age")).agg(F.count("*").alias("at_risk"), F.sum(event).cast("long").alias("deaths"))
    first = per.filter("deaths > 0").agg(F.min("age").alias("_first"))
    return curve.join(per, "age", "left").na.fill(0, ["at_risk", "deaths"]).join(F.broadcast(first)).select("*", (F.col("age") < F.col("_first")).alias("extrapolated")).drop("_first")


# -- V13, V18


def split_by_median(rows: DataFrame, covariates: list[str], time: str, event: str) -> dict[str, CoxFit]:
    """The same model among durations up to the median and beyond it."""
    median = numbered_median(rows.select(F.col(time).cast("double").alias("v")).filter("v is not null"), "v")
    specs = [Spec("short", tuple(covariates), f"{time} <= {median!r}"), Spec("long", tuple(covariates), f"{time} > {median!r}")]
    return cox_fits(rows, specs, time, event)


def effect_sizes(rows: DataFrame, covariates: list[str], stop: str, event: str, start: str | None = None, directional: dict[str, str] | None = None) -> list[tuple]:
    """Per covariate: hazard ratio per unit, deviation, interquartile range, hazard ratios with bands per deviation and per
    range, and the likelihood ratio of leaving it out. ``directional`` names a condition on the rows that scale a covariate."""
    specs = [Spec("all", tuple(covariates)), *(Spec(f"without_{c}", tuple(x for x in covariates if x != c)) for c in covariates)]
    complete = " and ".join(f"{c} is not null" for c in covariates)
    fits = cox_fits(rows.filter(complete), specs, stop, event, start)
    aggs = []
    for c in covariates:
        x = F.when(F.expr((directional or {}).get(c, "true")), F.col(c).cast("double"))
        aggs += [F.stddev_samp(x), F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))]
    scale = rows.filter(complete).agg(*aggs).first()
    fit, out = fits["all"], []
    for k, c in enumerate(covariates):
        b, s = float(fit.beta[k]), float(fit.se[k])
        sd, (q1, q3) = float(scale[2 * k] or 0), scale[2 * k + 1] or (0.0, 0.0)
        lr = 2 * (fit.loglik - fits[f"without_{c}"].loglik)
        band = lambda z: tuple(safe_exp(v * z) for v in (b, b - 1.96 * s, b + 1.96 * s))
        out.append((c, safe_exp(b), sd, *band(sd), float(q3 - q1), *band(float(q3 - q1)), float(lr), chi2_sf(float(lr), 1)))
    return out


def form_specs(base: tuple[str, ...], b: str = "b_lag", d: str = "d_lag") -> list[Spec]:
    """The ladder of forms of B, each without and with D, and B split by sign. Needs ``with_forms``."""
    forms = {"none": (), "linear": (b,), "abs": (b, "b_abs"), "cubic": (b, "b_abs", "b_square", "b_cube"), "signed": ("b_pos", "b_neg")}
    out = [s for name, extra in forms.items() for s in (Spec(name, base + extra), Spec(f"{name}_d", base + extra + (d,)))]
    return [s for s in out if s.covariates] + [Spec("bearish", base + (b, d, "bearish", "d_x_bearish"))]


def with_forms(rows: DataFrame, b: str = "b_lag", d: str = "d_lag") -> DataFrame:
    x, bearish = F.col(b), (F.col(b) < 0).cast("int")
    return rows.withColumns({"b_abs": F.abs(x), "b_square": x**2, "b_cube": x**3, "b_pos": F.greatest(x, F.lit(0.0)), "b_neg": F.least(x, F.lit(0.0)), "bearish": bearish, "d_x_bearish": F.col(d) * bearish})


# -- V20


def permuted(rows: DataFrame, value: str, keep: list[str], replicas: int, seed: int = 3) -> DataFrame:
    """Per replica the rows' ``keep`` columns with another row's value.

    Rows are numbered once; a keyed bijection of the numbers deals values, so no replica is sorted.
    """
    base = numbered(rows.select(value, *keep), *keep, value, name="_number")
    n = base.count()
    dealt = base.select("_number", value).mapInArrow(bijection(n, replicas, seed), f"replica int, _number long, {value} {dict(base.dtypes)[value]}")
    return dealt.join(base.select("_number", *keep), "_number").drop("_number")


def ignition_model(rows: DataFrame, covariates: list[str], time: str, event: str, start: str, cut: float, populations: dict[str, str], replicas: int = 500, seed: int = 3) -> DataFrame:
    """Per population (name to SQL condition): fits of all and of what ignited before the cut, concordance within and after
    the cut, its distribution over permutations of the risks, p = share of permutations that reach it, and the medians of
    duration by tercile of risk after the cut."""
    rows = rows.dropna(subset=covariates)
    specs = [Spec(f"{name}{side}", tuple(covariates), f"({cond}) and {more}") for name, cond in populations.items() for side, more in (("", "true"), (":train", f"{start} < {cut}"))]
    fits = cox_fits(rows, specs, time, event)
    out = []
    for name, cond in populations.items():
        risk = lambda fit: sum((F.col(c) * float(b) for c, b in zip(covariates, fit.beta)), F.lit(0.0))
        mine = rows.filter(cond)
        whole, train = fits[name], fits[f"{name}:train"]
        scored = mine.withColumn("_all", risk(whole)).withColumn("_train", risk(train))
        side = F.when(F.col(start) < cut, "train").otherwise("test")
        inside = survival.concordance(scored, "_all", time, event).first()["concordance"]
        by_side = {r["side"]: r["concordance"] for r in survival.concordance(scored.withColumn("side", side), "_train", time, event, ["side"]).collect()}
        test = scored.filter(F.col(start) >= cut).select(F.col("_train").alias("risk"), F.col(time).alias("t"), F.col(event).alias("e"))
        real = by_side.get("test")
        placebo = survival.concordance(permuted(test, "risk", ["t", "e"], replicas, seed), "risk", "t", "e", ["replica"])
        reach = F.avg((F.col("concordance") >= (math.nan if real is None else real)).cast("double"))
        p = placebo.agg(F.avg("concordance").alias("m"), F.percentile("concordance", F.lit(0.95)).alias("q"), reach.alias("p"), F.count("concordance").alias("n")).first()
        medians = qcut(test, "risk", 3).groupBy("bin").agg(F.percentile("t", F.lit(0.5)).alias("m")).collect()
        by_bin = {r["bin"]: float(r["m"]) for r in medians}
        n_train = train.rows
        hr = [float(safe_exp(b)) for b in whole.beta]
        out.append((name, whole.rows, hr, inside, n_train, whole.rows - n_train, by_side.get("train"), real, int(p["n"]), p["m"], p["q"], p["p"], by_bin.get(1), by_bin.get(2), by_bin.get(3)))
    schema = "population string, n long, hr array<double>, c_within double, n_train long, n_test long, c_train double, c_test double, permutations long, placebo_mean double, placebo_p95 double, p double, median_low double, median_mid double, median_high double"
    return rows.sparkSession.createDataFrame(out, schema)


def exclusion_auc(rows: DataFrame, covariates: list[str], time: str, event: str, kept: str) -> DataFrame:
    """How well the risk of the model of all rows tells the rows apart that a filter excludes (higher risk: excluded)."""
    rows = rows.dropna(subset=covariates)
    fit = cox_fits(rows, [Spec("all", tuple(covariates))], time, event)["all"]
    risk = sum((F.col(c) * float(b) for c, b in zip(covariates, fit.beta)), F.lit(0.0))
    scored = rows.select(risk.alias("risk"), F.expr(kept).cast("int").alias("kept"), (~F.expr(kept)).cast("int").alias("gone"))
    auc = survival.concordance(scored, "risk", "kept", "gone").select(F.col("pairs"), F.col("concordance").alias("auc"))
    medians = scored.agg(F.percentile(F.when(F.col("kept") == 1, F.exp("risk")), F.lit(0.5)).alias("median_kept"), F.percentile(F.when(F.col("kept") == 0, F.exp("risk")), F.lit(0.5)).alias("median_gone"))
    return auc.join(medians)
