"""Event detector: ignition and extinction of attention per symbol, with attributes, sweeps and daily state.

The automaton is order-dependent (its threshold follows a running peak), so it runs as one fold over a symbol's steps. A
symbol has at most one row per step of the calendar, which bounds the group; symbols that can't ignite are dropped before.
``detect`` folds inside the JVM, ``Automaton`` is the same machine for pandas groups and streams.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, series


@dataclass(frozen=True)
class Params:
    window: int = 30
    least: int = 15
    z_on: float = 4.0
    min_abs: float = 30
    kappa: float = 0.25
    k_off: int = 5
    gap: int = 5
    min_steps: int = 3
    min_total: int = 300
    robust: bool = False


def candidates(dense: DataFrame, min_abs: float) -> DataFrame:
    """series of symbols that reach the absolute minimum at all."""
    able = dense.groupBy("symbol").agg(F.max("n").alias("_m")).filter(F.col("_m") >= min_abs).select("symbol")
    return dense.join(able, "symbol", "left_semi")


def scored(dense: DataFrame, p: Params) -> DataFrame:
    """Baselines and z of the candidate series."""
    able = candidates(dense, p.min_abs)
    based = series.baseline_robust(able, p.window, p.least) if p.robust else series.baseline(able, p.window, p.least)
    return series.zscore(based)


_EVENT = "struct<start:bigint,end:bigint,censored:boolean,mu0:double,sigma0:double,z0:double>"
_STATE = f"struct<on:boolean,start:bigint,mu0:double,sigma0:double,z0:double,peak:double,below:int,last:bigint,events:array<{_EVENT}>>"


def _fold(z_on: str, min_abs: str, kappa: str, k_off: str) -> str:
    """The automaton as an aggregate over steps; parameters are SQL expressions, so that a sweep can pass columns.

    An event freezes its baseline at ignition, the deviation with the floor that z has: ``sigma0`` is the largest of the
    deviation, the root of the mean and 1.
    """
    ignites = f"(not s.on and r.z >= {z_on} and r.n >= {min_abs})"
    peak = "greatest(s.peak, cast(r.n as double))"
    below = f"case when r.n < greatest(s.mu0 + s.sigma0, {kappa} * {peak}) then s.below + 1 else 0 end"
    ends = f"(s.on and ({below}) >= {k_off})"
    event = f"named_struct('start', s.start, 'end', r.step - {k_off}, 'censored', false, 'mu0', s.mu0, 'sigma0', s.sigma0, 'z0', s.z0)"
    step = f"""case
        when {ignites} then named_struct('on', true, 'start', r.step, 'mu0', r.mu, 'sigma0', greatest(r.sigma, sqrt(r.mu), 1d), 'z0', r.z, 'peak', cast(r.n as double), 'below', 0, 'last', r.step, 'events', s.events)
        when {ends} then named_struct('on', false, 'start', s.start, 'mu0', s.mu0, 'sigma0', s.sigma0, 'z0', s.z0, 'peak', s.peak, 'below', 0, 'last', r.step, 'events', concat(s.events, array({event})))
        when s.on then named_struct('on', true, 'start', s.start, 'mu0', s.mu0, 'sigma0', s.sigma0, 'z0', s.z0, 'peak', {peak}, 'below', {below}, 'last', r.step, 'events', s.events)
        else named_struct('on', false, 'start', s.start, 'mu0', s.mu0, 'sigma0', s.sigma0, 'z0', s.z0, 'peak', s.peak, 'below', s.below, 'last', r.step, 'events', s.events) end"""
    start = "named_struct('on', false, 'start', 0L, 'mu0', 0d, 'sigma0', 0d, 'z0', 0d, 'peak', 0d, 'below', 0, 'last', 0L, 'events', array())"
    open_event = "named_struct('start', s.start, 'end', s.last, 'censored', true, 'mu0', s.mu0, 'sigma0', s.sigma0, 'z0', s.z0)"
    return f"aggregate(rows, cast({start} as {_STATE}), (s, r) -> cast({step} as {_STATE}), s -> case when s.on then concat(s.events, array({open_event})) else s.events end)"


def _lists(z: DataFrame, *keys: str) -> DataFrame:
    return z.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "n", "mu", "sigma", "z"))).alias("rows"))


def detect(z: DataFrame, p: Params) -> DataFrame:
    """Events (symbol, start, end, censored, mu0, sigma0, z0) of scored series; counts may be fractional."""
    events = _lists(z, "symbol").select("symbol", F.explode(F.expr(_fold(str(p.z_on), str(p.min_abs), str(p.kappa), str(p.k_off)))).alias("e"))
    return events.select("symbol", "e.*")


class Automaton:
    """The same machine, one step at a time; its state is a plain tuple for streaming stores."""

    def __init__(self, p: Params, state: tuple | None = None):
        self.p = p
        self.on, self.start, self.mu, self.sigma, self.z, self.peak, self.below, self.last = state or (False, 0, 0.0, 0.0, 0.0, 0.0, 0, 0)

    @property
    def state(self) -> tuple:
        return self.on, self.start, self.mu, self.sigma, self.z, self.peak, self.below, self.last

    def feed(self, step: int, n: float, mu: float, sigma: float, z: float) -> tuple | None:
        """An event (start, end, censored, mu0, sigma0, z0) when it ends here."""
        self.last = step
        if not self.on:
            if z == z and z >= self.p.z_on and n >= self.p.min_abs:
                self.on, self.start, self.mu, self.sigma, self.z, self.peak, self.below = True, step, mu, max(sigma, mu**0.5, 1.0), z, float(n), 0
            return None
        self.peak = max(self.peak, float(n))
        self.below = self.below + 1 if n < max(self.mu + self.sigma, self.p.kappa * self.peak) else 0
        if self.below >= self.p.k_off:
            self.on, self.below = False, 0
            return self.start, step - self.p.k_off, False, self.mu, self.sigma, self.z
        return None

    def close(self) -> tuple | None:
        return (self.start, self.last, True, self.mu, self.sigma, self.z) if self.on else None


def detect_in_pandas(z: DataFrame, p: Params) -> DataFrame:
    """F1 by ``Automaton`` on pandas groups; ``detect`` and the stream must agree with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, found = Automaton(p), []
        for r in pdf.sort_values("step").itertuples(index=False):
            if e := machine.feed(int(r.step), r.n, r.mu, r.sigma, r.z):
                found.append(e)
        if e := machine.close():
            found.append(e)
        out = pd.DataFrame(found, columns=["start", "end", "censored", "mu0", "sigma0", "z0"])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return out

    return z.select("symbol", "step", "n", "mu", "sigma", "z").groupBy("symbol").applyInPandas(run, "symbol string, start long, end long, censored boolean, mu0 double, sigma0 double, z0 double")


def merge_close(events: DataFrame, gap: int | Column, *keys: str) -> DataFrame:
    """events of a symbol at most ``gap`` apart are one; the first's baseline and the last's censoring stay, ``n_merged`` counts them."""
    by = keys or ("symbol",)
    w = Window.partitionBy(*by).orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    numbered = events.withColumn("_g", F.sum(fresh.cast("int")).over(w))
    first = [F.min_by(c, "start").alias(c) for c in ("mu0", "sigma0", "z0")] + [F.count("*").alias("n_merged")]
    return numbered.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("censored", "start").alias("censored"), *first).drop("_g")


def finalize(events: DataFrame, dense: DataFrame, p: Params) -> DataFrame:
    """duration, peak (first of equal ones), total, amplitude, and the flags for principal and slow events."""
    e = events.withColumn("event_id", F.concat_ws("_", "symbol", F.col("start").cast("string")))
    rows = joins.event_steps(e).join(dense, ["symbol", "step"])
    stats = rows.groupBy("event_id").agg(F.max_by("step", F.struct("n", (-F.col("step")).alias("s"))).alias("peak"), F.max("n").alias("peak_n"), F.sum("n").alias("total"))
    out = e.join(stats, "event_id")
    duration = F.col("end") - F.col("start") + 1
    amplitude = F.col("peak_n") / F.greatest("mu0", F.lit(1.0))
    return out.select(
        "event_id", "symbol", "start", "peak", "end", duration.alias("duration"), (F.col("peak") - F.col("start")).alias("to_peak"), "peak_n", "total", "mu0", "sigma0", "z0", "censored",
        ((duration >= p.min_steps) & (F.col("total") >= p.min_total)).alias("principal"), amplitude.alias("amplitude"), ((duration >= 60) & (amplitude < 8)).alias("slow"), "n_merged",
    )


def catalog(dense: DataFrame, p: Params) -> DataFrame:
    """F1 to F4 over a dense series."""
    return finalize(merge_close(detect(scored(dense, p), p), p.gap), dense, p)


def sweep(dense: DataFrame, grid: dict[str, Params]) -> DataFrame:
    """the events of each scenario after fusion of close ones, with duration, total and whether they are principal.

    Scenarios that share a baseline fold over one list of steps, the parameters as columns.
    """
    spark, parts = dense.sparkSession, []
    for robust in sorted({p.robust for p in grid.values()}):
        for window, least in sorted({(p.window, p.least) for p in grid.values() if p.robust == robust}):
            mine = {k: p for k, p in grid.items() if (p.robust, p.window, p.least) == (robust, window, least)}
            able = Params(window=window, least=least, robust=robust, min_abs=min(p.min_abs for p in mine.values()))
            rows = [(k, *(float(getattr(p, f.name)) for f in fields(p) if f.name in ("z_on", "min_abs", "kappa")), p.k_off, p.gap, p.min_steps, p.min_total) for k, p in mine.items()]
            table = spark.createDataFrame(rows, "scenario string, z_on double, min_abs double, kappa double, k_off int, gap int, min_steps int, min_total long")
            lists = _lists(scored(dense, able), "symbol").join(F.broadcast(table))
            fold = F.expr(_fold("z_on", "min_abs", "kappa", "k_off"))
            found = lists.select("scenario", "symbol", "gap", "min_steps", "min_total", F.explode(fold).alias("e"))
            parts.append(merge_close(found.select("scenario", "symbol", "gap", "min_steps", "min_total", "e.*"), F.col("gap"), "scenario", "symbol", "gap", "min_steps", "min_total"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # totals from running sums at both ends of an event
    sums = dense.select("symbol", "step", "n", F.sum("n").over(Window.partitionBy("symbol").orderBy("step")).alias("_c"))
    first, last = sums.select("symbol", F.col("step").alias("start"), (F.col("_c") - F.col("n")).alias("_before")), sums.select("symbol", F.col("step").alias("end"), "_c")
    out = out.join(first, ["symbol", "start"]).join(last, ["symbol", "end"])
    duration, total = F.col("end") - F.col("start") + 1, F.col("_c") - F.col("_before")
    principal = (duration >= F.col("min_steps")) & (total >= F.col("min_total"))
    return out.select("scenario", "symbol", "start", "end", "censored", "mu0", "sigma0", "z0", duration.alias("duration"), total.alias("total"), principal.alias("principal"))


def compare_scenarios(events: DataFrame, anchor: str, episode: tuple[str, int] | None = None) -> DataFrame:
    """per scenario: principal events, symbols, censored ones, median, 90 % point and maximum of durations, share of the
    anchor scenario's that overlap one, median difference of durations to the first one that overlaps, and the duration of the
    event that holds ``episode`` (symbol, step)."""
    span = F.col("end") - F.col("start") + 1
    events = events.filter("principal")
    base = events.filter(F.col("scenario") == anchor).select("symbol", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    met = base.join(events.select("scenario", "symbol", "start", "end"), "symbol").filter((F.col("start") <= F.col("a_end")) & (F.col("end") >= F.col("a_start")))
    first = F.min_by(F.abs(span - (F.col("a_end") - F.col("a_start") + 1)), "start").alias("d")
    per = met.groupBy("scenario", "symbol", "a_start", "a_end").agg(first)
    n_anchor = base.agg(F.count("*").alias("n_anchor"))
    found = per.groupBy("scenario").agg(F.count("*").alias("recovered"), F.percentile("d", F.lit(0.5)).alias("median_difference"))
    held = (F.col("symbol") == episode[0]) & F.lit(episode[1]).between(F.col("start"), F.col("end")) if episode else F.lit(False)
    sizes = events.groupBy("scenario").agg(
        F.count("*").alias("n_events"), F.countDistinct("symbol").alias("n_symbols"), F.count_if("censored").alias("n_censored"), F.percentile(span, F.lit(0.5)).alias("median_duration"),
        F.percentile(span, F.lit(0.9)).alias("p90_duration"), F.max(span).alias("longest"), F.min_by(F.when(held, span), F.when(held, F.col("start"))).alias("episode_duration"),
    )
    share = F.round(F.coalesce(F.col("recovered"), F.lit(0)) / F.col("n_anchor"), 6).alias("recovered_share")
    return sizes.join(found, "scenario", "left").join(F.broadcast(n_anchor)).select(*sizes.columns, share, "median_difference")


def detector_daily(cat: DataFrame, dense: DataFrame, p: Params) -> DataFrame:
    """each step of each event and of its confirmation, with what was known then."""
    e = cat.withColumn("last", F.when(F.col("censored"), F.col("end")).otherwise(F.col("end") + p.k_off))
    steps = e.select("event_id", "symbol", "start", F.col("end").alias("event_end"), "mu0", "sigma0", F.explode(F.sequence("start", "last")).alias("step"))
    state = series.event_state(steps.join(dense, ["symbol", "step"]), p.kappa)
    phase = F.when(F.col("step") <= F.col("event_end"), "event").otherwise("confirmation")
    return state.withColumn("age", F.col("step") - F.col("start") + 1).withColumn("phase", phase)


def eligibility_table(cat: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """F8: end, confirmation, the step of eligibility, whether the event dies on it, and the events that were fused."""
    known = series.eligibility(daily, p.min_total, p.min_steps)
    out = cat.select("event_id", "symbol", "start", "end", "censored", "n_merged").join(known, "event_id", "left")
    return out.withColumn("confirmed", F.when(~F.col("censored"), F.col("end") + p.k_off)).withColumn("dies_on_eligibility", F.col("eligible") == F.col("end"))


def band_bubbles(dense: DataFrame, window: int = 15, least_band: int = 2) -> DataFrame:
    """runs of steps above a band, as intervals."""
    return series.runs(series.bands(dense, window).withColumn("flag", F.col("band") >= least_band), "flag")


def bubble_cover(cat: DataFrame, bubbles: DataFrame) -> DataFrame:
    """how many of a catalog's events overlap some bubble of their symbol."""
    met = joins.overlap_join(cat.select("symbol", "start", "end"), bubbles.select("symbol", "start", "end"), "symbol")
    per = met.groupBy("symbol", "a_start").agg(F.count("b_start").alias("_n"))
    return per.agg(F.count("*").alias("events"), F.count_if(F.col("_n") > 0).alias("covered"), F.round(F.try_divide(F.count_if(F.col("_n") > 0), F.count("*")), 6).alias("share"))


def compare_catalogs(a: DataFrame, b: DataFrame) -> DataFrame:
    """events of both catalogs, pairs matched one to one, and what each has alone."""
    sizes = a.agg(F.count("*").alias("n_a")).join(b.agg(F.count("*").alias("n_b")))
    pairs = joins.match_catalogs(a, b).agg(F.count("*").alias("matched"))
    return sizes.join(pairs).select("n_a", "n_b", "matched", (F.col("n_a") - F.col("matched")).alias("only_a"), (F.col("n_b") - F.col("matched")).alias("only_b"))


def twin_events(cat: DataFrame, pairs: DataFrame) -> DataFrame:
    """for named pairs of symbols (a, b): overlapping events, the same episode in both."""
    mine = lambda name: pairs.join(cat.select(F.col("symbol").alias(name), "start", "end"), name).select("a", "b", "start", "end").withColumn("pair", F.struct("a", "b"))
    met = joins.overlap_join(mine("a"), mine("b"), "pair", keep_unmatched=False)
    n = met.groupBy("pair").agg(F.count("*").alias("overlapping"))
    return pairs.select("a", "b").withColumn("pair", F.struct("a", "b")).join(n, "pair", "left").na.fill(0, ["overlapping"]).drop("pair")


def fact_profile(facts: DataFrame, dense: DataFrame, around: int = 7) -> DataFrame:
    """the series around dated facts, by distance."""
    near = facts.select("fact_id", "symbol", F.col("step").alias("at"), F.explode(F.sequence(F.col("step") - around, F.col("step") + around)).alias("step"))
    return near.join(dense, ["symbol", "step"]).select("fact_id", (F.col("step") - F.col("at")).alias("offset"), "n")


def twin_audit(dense: DataFrame, pairs: DataFrame) -> DataFrame:
    """for named pairs of symbols: correlations of levels and logs, share of steps on which both are positive."""
    a, b = dense.select(F.col("symbol").alias("a"), "step", F.col("n").alias("na")), dense.select(F.col("symbol").alias("b"), "step", F.col("n").alias("nb"))
    both = pairs.join(a, "a").join(b, ["b", "step"])
    return both.groupBy("a", "b").agg(
        F.round(F.corr("na", "nb"), 6).alias("corr"), F.round(F.corr(F.log1p("na"), F.log1p("nb")), 6).alias("log_corr"), F.round(F.avg(((F.col("na") > 0) & (F.col("nb") > 0)).cast("int")), 6).alias("both_positive")
    )


def online_z(buffer: list[float], n: float, p: Params) -> tuple[float, float, float]:
    """(mu, sigma, z) of a count from the buffer of those before it, as ``series.baseline`` gives them."""
    nan = float("nan")
    if len(buffer) < max(2, p.least):
        return nan, nan, nan
    mu = sum(buffer) / len(buffer)
    sigma = (sum((x - mu) ** 2 for x in buffer) / (len(buffer) - 1)) ** 0.5
    return mu, sigma, (n - mu) / max(sigma, mu**0.5, 1.0)
