"""Stance panels, market covariates and news labels around events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins
from .ranks import quantiles


def optimism(bull: Column, bear: Column) -> Column:
    """H1: B = ln((1 + bull) / (1 + bear))."""
    return F.log((1 + bull) / (1 + bear))


def disagreement(bull: Column, bear: Column) -> Column:
    """H1: D = 1 - |bull - bear| / (bull + bear), null without directional messages."""
    return 1 - F.try_divide(F.abs(bull - bear), bull + bear)


def sentiment_panel(events: DataFrame, daily: DataFrame, pre: int = 7, post: int = 7) -> DataFrame:
    """H2: every step of every event's window with phase, age, counts and indices."""
    rows = joins.event_steps(events, pre, post).join(daily, ["symbol", "step"], "left").na.fill(0, ["n", "m_bull", "m_bear", "m_neutral"]).na.fill(0.0, ["s_bull", "s_bear", "s_neutral"])
    phase = F.when(F.col("step") < F.col("start"), "pre").when(F.col("step") > F.col("end"), "post").otherwise("event")
    return rows.select(
        "event_id", "symbol", "step", "start", "end", phase.alias("phase"), (F.col("step") - F.col("start")).alias("age"), "n", "m_bull", "m_bear", "m_neutral", "s_bull", "s_bear", "s_neutral",
        optimism(F.col("m_bull"), F.col("m_bear")).alias("b"), disagreement(F.col("m_bull"), F.col("m_bear")).alias("d"),
        optimism(F.col("s_bull"), F.col("s_bear")).alias("b_prob"), disagreement(F.col("s_bull"), F.col("s_bear")).alias("d_prob"),
    )


def start_stop(panel: DataFrame, censored: DataFrame, lag: int = 1, frontier: int | None = None) -> DataFrame:
    """H3, H4: unit intervals (start, stop] of event steps with covariates of ``lag`` steps earlier.

    Death is on the last step unless the event is censored; a frontier censors what lies beyond the covered steps.
    """
    rows = panel.filter("phase = 'event'")
    past = panel.select("event_id", (F.col("step") + lag).alias("step"), F.col("b").alias("b_lag"), F.col("d").alias("_d"), F.log1p("n").alias("log_n_lag"))
    out = rows.select("event_id", "symbol", "step", "age", F.col("start").alias("ignition"), "end").join(past, ["event_id", "step"]).join(censored.select("event_id", "censored"), "event_id")
    if frontier is not None:
        out = out.filter(F.col("step") <= frontier)
    death = (F.col("step") == F.col("end")) & ~F.col("censored")
    return out.select(
        "event_id", "symbol", F.col("age").alias("start"), (F.col("age") + 1).alias("stop"), death.cast("int").alias("death"), "b_lag",
        F.coalesce("_d", F.lit(0.5)).alias("d_lag"), F.col("_d").isNull().cast("int").alias("silent_lag"), "log_n_lag", "step",
    )


def coverage_frontier(events: DataFrame, days: DataFrame) -> DataFrame:
    """H4: per event the last step before the first whose previous step ``days`` (symbol, step) doesn't cover.

    ``truncated`` marks events that the frontier cuts; an event not covered at its first step has no row.
    """
    past = days.select("symbol", (F.col("step") + 1).alias("step")).distinct().withColumn("_there", F.lit(1))
    rows = joins.event_steps(events).join(past, ["symbol", "step"], "left")
    gap = F.min(F.when(F.col("_there").isNull(), F.col("step")))
    found = rows.groupBy("event_id", "start", "end").agg(gap.alias("_gap")).withColumn("frontier", F.coalesce(F.col("_gap") - 1, F.col("end")))
    return found.filter("frontier >= start").select("event_id", "frontier", (F.col("frontier") < F.col("end")).alias("truncated"))


def start_stop_covered(panel: DataFrame, censored: DataFrame, frontier: DataFrame, lag: int = 1) -> DataFrame:
    """H4: the intervals of ``start_stop`` up to each event's frontier; an event that its frontier cuts has no death."""
    return start_stop(panel, censored, lag).join(frontier.select("event_id", "frontier"), "event_id").filter("step <= frontier").drop("frontier")


def delayed_entry(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """H5: only steps after the event became eligible."""
    return rows.join(eligible.filter("eligible is not null").select("event_id", "eligible"), "event_id").filter("step > eligible")


def adjust_counts(df: DataFrame, columns: list[str], confusion: list[list[float]]) -> DataFrame:
    """H6: counts corrected by the inverse of a row-stochastic confusion matrix, not below 0, with the row's total kept."""
    inverse = np.linalg.inv(np.array(confusion).T)
    raw = [F.greatest(sum((F.col(c) * float(inverse[i, j]) for j, c in enumerate(columns)), F.lit(0.0)), F.lit(0.0)) for i in range(len(columns))]
    total, fixed = sum((F.col(c) for c in columns), F.lit(0)), sum(raw, F.lit(0.0))
    return df.select("*", *(F.when(fixed > 0, r * total / fixed).otherwise(0.0).alias(f"{c}_adjusted") for r, c in zip(raw, columns)))


def degraded(confusion: list[list[float]], row: int, factor: float) -> list[list[float]]:
    """H7: a row-stochastic confusion matrix with one class recognised less often; the loss goes to the other predictions in
    proportion to its measured confusions (evenly where there are none)."""
    out = [list(r) for r in confusion]
    loss, others = out[row][row] * (1 - factor), [j for j in range(len(out)) if j != row]
    total = sum(out[row][j] for j in others)
    for j in others:
        out[row][j] += loss * (out[row][j] / total if total else 1 / len(others))
    out[row][row] *= factor
    return out


def with_strata(rows: DataFrame, size: str = "n", age: str = "age", early: int = 5) -> DataFrame:
    """H7: the strata of error injection: tercile of the size among rows that have any, early or late, majority of the day."""
    cuts = quantiles(rows.filter(F.col(size) > 0), size, [1 / 3, 2 / 3])
    volume = F.when(F.col(size) <= cuts[0], "low").when(F.col(size) <= cuts[1], "middle").otherwise("high") if cuts else F.lit("low")
    return rows.withColumns({"volume": volume, "moment": F.when(F.col(age) <= early, "early").otherwise("late"), "side": F.when(F.col("m_bull") >= F.col("m_bear"), "bull").otherwise("bear")})


def perturb_counts(df: DataFrame, key: list[str], columns: list[str], confusion: list[list[float]], replicas: int, seed: int = 11, strata: str | None = None, matrices: dict[str, list[list[float]]] | None = None) -> DataFrame:
    """H7: counts redrawn from a confusion matrix (rows: true classes), per replica, with the row's total kept.

    With ``strata`` a row takes the matrix that ``matrices`` has for its stratum, else ``confusion``. All replicas of a row are
    drawn together, class by class; the draws depend on the row's key and the seed only.
    """
    by_stratum = {k: np.array(m) for k, m in (matrices or {}).items()}
    usual, k = np.array(confusion), len(columns)
    rows = df.select(*key, *([F.col(strata).cast("string").alias("_stratum")] if strata else [F.lit("").alias("_stratum")]), *columns, F.xxhash64(F.lit(seed), *key).alias("_seed"))
    n_key = len(key)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(n_key + 1 + j).to_numpy(zero_copy_only=False) for j in range(k)], 1)
            out = np.zeros((batch.num_rows, replicas, k), np.int64)
            for r, (stratum, own) in enumerate(zip(batch.column(n_key).to_pylist(), batch.column(n_key + 1 + k).to_pylist())):
                rng, matrix = np.random.Generator(np.random.Philox(key=own % (1 << 63))), by_stratum.get(stratum, usual)
                for j in range(k):
                    out[r] += rng.multinomial(int(counts[r, j]), matrix[j], replicas)
            places = pa.array(np.repeat(np.arange(batch.num_rows), replicas))
            same = [batch.column(j).take(places) for j in range(n_key)]
            numbers = pa.array(np.tile(np.arange(1, replicas + 1, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*same, numbers, *(pa.array(out[:, :, j].reshape(-1)) for j in range(k))], [*key, "replica", *columns])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)
    return rows.mapInArrow(draw, f"{kinds}, replica int, " + ", ".join(f"{c} long" for c in columns))


def early_features(panel: DataFrame, steps: int = 3) -> DataFrame:
    """H8: means of the first steps, with a dummy where D is undefined."""
    rows = panel.filter((F.col("phase") == "event") & (F.col("age") < steps))
    return rows.groupBy("event_id").agg(F.avg("b").alias("early_b"), F.coalesce(F.avg("d"), F.lit(0.5)).alias("early_d"), F.avg("d").isNull().cast("int").alias("early_silent"))


# -- market


def placed_prices(prices: DataFrame, lives: DataFrame, source: str, horizon: int | None = None) -> DataFrame:
    """A block of (instrument, step, close, ret, volume) under the symbols of the lives (instrument, symbol, start, end) that
    contain its days, closes without sign; an open end reaches the horizon or is endless."""
    end = F.coalesce("end", F.lit(horizon)) if horizon is not None else F.col("end")
    met = prices.join(lives.select("instrument", "symbol", F.col("start").alias("_from"), end.alias("_to")), "instrument")
    inside = (F.col("step") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("step") <= F.col("_to")))
    return met.filter(inside).select("symbol", "step", "instrument", F.abs("close").alias("close"), "ret", "volume", F.lit(source).alias("source"), F.col("_from").alias("life_start"))


def price_conflicts(placed: DataFrame) -> DataFrame:
    """Days on which several instruments have rows under one symbol: how many, and which."""
    per = placed.groupBy("symbol", "step").agg(F.array_sort(F.collect_set("instrument")).alias("instruments"))
    return per.filter(F.size("instruments") > 1).select("symbol", "step", F.size("instruments").alias("n"), F.array_join(F.transform("instruments", lambda i: i.cast("string")), ",").alias("instruments"))


def price_panel(placed: list[DataFrame]) -> DataFrame:
    """One row per symbol and day from blocks in order of precedence: the first block, in it the life that began last, then
    the smallest instrument; ``candidates`` counts the rows that met there."""
    rows = None
    for rank, block in enumerate(placed):
        block = block.withColumn("_rank", F.lit(rank))
        rows = block if rows is None else rows.unionByName(block)
    best = F.min(F.struct("_rank", (-F.col("life_start")).alias("late"), "instrument", "close", "ret", "volume", "source")).alias("b")
    return rows.groupBy("symbol", "step").agg(best, F.count("*").alias("candidates")).select("symbol", "step", "b.instrument", "b.close", "b.ret", "b.volume", "b.source", "candidates")


def price_covariates(events: DataFrame, prices: DataFrame, before: int = 30, pad: int = 5) -> DataFrame:
    """Returns and volumes of an event by one join over [start - before, end + pad]; needs enough sessions."""
    window = events.select("event_id", "symbol", "start", "peak", "end", F.explode(F.sequence(F.col("start") - before, F.col("end") + pad)).alias("step"))
    rows = window.join(prices.select("symbol", "step", "close", "volume"), ["symbol", "step"])
    pre, inside = F.col("step") < F.col("start"), F.col("step").between(F.col("start"), F.col("end"))
    near = F.col("step") >= F.col("start") - pad
    at = lambda cond, how, c: how(F.when(cond, F.col(c)), F.when(cond, F.col("step")))
    agg = rows.groupBy("event_id", "start", "peak").agg(
        F.count_if(pre).alias("_pre"), F.count_if(inside).alias("_in"), at(pre, F.max_by, "close").alias("_base"), at(inside & (F.col("step") <= F.col("peak")), F.max_by, "close").alias("_peak"),
        at(inside, F.max_by, "close").alias("_end"), F.max(F.when(inside, F.col("close"))).alias("_max"), F.avg(F.when(pre, F.col("volume"))).alias("_vpre"), F.avg(F.when(inside, F.col("volume"))).alias("_vin"),
        F.max_by(F.when(near, F.col("step")), F.when(near, F.struct("close", (-F.col("step")).alias("s")))).alias("_argmax"),
    )
    ok = (F.col("_pre") >= 5) & (F.col("_in") >= 2)
    ratio = lambda x, y: F.when(ok, F.try_divide(F.col(x), F.col(y)))
    return agg.select("event_id", (ratio("_peak", "_base") - 1).alias("ret_to_peak"), (ratio("_end", "_peak") - 1).alias("ret_peak_to_end"), (ratio("_max", "_base") - 1).alias("ret_max"), ratio("_vin", "_vpre").alias("volume_ratio"), F.when(ok, F.col("_argmax") - F.col("peak")).alias("price_lag"))


def peak_lag(events: DataFrame, prices: DataFrame, k: int) -> DataFrame:
    """Steps from the attention peak to the highest close within k steps (first of equal ones)."""
    near = events.select("event_id", "symbol", "peak", F.explode(F.sequence(F.col("peak") - k, F.col("peak") + k)).alias("step"))
    rows = near.join(prices, ["symbol", "step"]).filter("close is not null")
    return rows.groupBy("event_id", "peak").agg(F.max_by("step", F.struct("close", (-F.col("step")).alias("s"))).alias("_s")).select("event_id", (F.col("_s") - F.col("peak")).alias("lag"))


def missing_price_causes(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Why an event has no price: symbol never priced, priced only before or after, or gaps."""
    span = prices.groupBy("symbol").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    has = joins.event_steps(events).join(prices.select("symbol", "step"), ["symbol", "step"], "left_semi").select("event_id").distinct()
    lost = events.join(has, "event_id", "left_anti").join(span, "symbol", "left")
    cause = F.when(F.col("_lo").isNull(), "never_priced").when(F.col("end") < F.col("_lo"), "before_listing").when(F.col("start") > F.col("_hi"), "after_delisting").otherwise("gap")
    return lost.select("event_id", cause.alias("cause"))


def instrument_at(events: DataFrame, lives: DataFrame) -> DataFrame:
    """P5: the instrument valid at ignition, else any of the symbol (the earliest)."""
    l = lives.select(F.col("symbol").alias("_s"), F.col("start").alias("_from"), F.col("end").alias("_to"), "instrument")
    met = events.join(l, events["symbol"] == l["_s"], "left")
    valid = F.col("start").between(F.col("_from"), F.col("_to"))
    best = F.min(F.struct((~F.coalesce(valid, F.lit(False))).alias("late"), "_from", "instrument"))
    return met.groupBy("event_id").agg(best.alias("b")).select("event_id", F.col("b.instrument").alias("instrument"), (~F.col("b.late")).alias("valid_then"))


def life_snapshot(lives: DataFrame, months: DataFrame) -> DataFrame:
    """Of the month rows inside a life, the last one's value and the mean dollar volume per trading day."""
    met = lives.join(months, "symbol").filter(F.col("month").between(F.col("start"), F.col("end")))
    return met.groupBy("symbol", "start").agg(F.max("month").alias("last_month"), F.max_by("close", "month").alias("last_close"), (F.avg(F.col("close") * F.col("volume") * 100) / 21).alias("dollar_volume"))


def compare_covariates(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per covariate: rows in both, equal ones, correlation, mean absolute difference."""
    x = a.select(key, *columns).unpivot(key, columns, "covariate", "va")
    y = b.select(key, *columns).unpivot(key, columns, "covariate", "vb")
    both = x.join(y, [key, "covariate"]).dropna()
    return both.groupBy("covariate").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("va") - F.col("vb")) < 1e-9).alias("equal"), F.round(F.corr("va", "vb"), 6).alias("corr"), F.round(F.avg(F.abs(F.col("va") - F.col("vb"))), 6).alias("mean_difference"))


# -- news


def census_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per symbol: correlation of log counts of two sources and whether they peak on the same step."""
    both = a.select("symbol", "step", F.col("n").alias("na")).join(b.select("symbol", "step", F.col("n").alias("nb")), ["symbol", "step"])
    first = lambda c: F.max_by("step", F.struct(c, (-F.col("step")).alias("s")))
    return both.groupBy("symbol").agg(F.round(F.corr(F.log1p("na"), F.log1p("nb")), 6).alias("log_corr"), (first("na") == first("nb")).alias("same_peak"))


def label_institutional(events: DataFrame, press: DataFrame, least: int = 15, prior: DataFrame | None = None) -> DataFrame:
    """Press around ignition against the 30 steps before.

    Echo (A): the peak reaches 5 and three medians; floor (B): 15 and three medians; main (D): A and twice the base's
    maximum. The label is ``prior``'s (event_id, prior: earnings or undated) where it has one, else "uncovered" without
    enough press, "institutional" by D, "native" for the rest.
    """
    near = events.select("event_id", "symbol", "start", F.explode(F.sequence(F.col("start") - 32, F.col("start") + 2)).alias("step"))
    rows = near.join(press, ["symbol", "step"])
    base, window = F.col("step") <= F.col("start") - 3, F.col("step") >= F.col("start") - 2
    agg = rows.groupBy("event_id").agg(F.count_if(base).alias("_n"), F.percentile(F.when(base, F.col("n")), F.lit(0.5)).alias("_median"), F.max(F.when(base, F.col("n"))).alias("_base_max"), F.max(F.when(window, F.col("n"))).alias("_peak"))
    enough = F.coalesce((F.col("_n") >= least) & F.col("_peak").isNotNull(), F.lit(False))
    a = F.col("_peak") >= F.greatest(F.lit(5.0), 3 * F.col("_median"))
    b, d = F.col("_peak") >= F.greatest(F.lit(15.0), 3 * F.col("_median")), a & (F.col("_peak") >= 2 * F.col("_base_max"))
    label = F.when(~enough, "uncovered").when(d, "institutional").otherwise("native")
    out = events.select("event_id").join(agg, "event_id", "left")
    if prior is not None:
        out = out.join(prior.select("event_id", "prior"), "event_id", "left")
        label = F.coalesce("prior", label)
    return out.select("event_id", *(F.when(enough, c).alias(n) for c, n in ((a, "echo"), (b, "floor"), (d, "main"))), label.alias("label"))


def press_echo(events: DataFrame, press: DataFrame, around: int = 5) -> DataFrame:
    """The press peak within some steps of the forum's (ties: the closest), its offset, and whether it clears the threshold."""
    median = press.groupBy("symbol").agg(F.percentile("n", F.lit(0.5)).alias("_median"))
    near = events.select("event_id", "symbol", "peak", F.explode(F.sequence(F.col("peak") - around, F.col("peak") + around)).alias("step"))
    offset = F.col("step") - F.col("peak")
    best = near.join(press, ["symbol", "step"]).groupBy("event_id", "symbol").agg(F.max(F.struct("n", (-F.abs(offset)).alias("close"), (-offset).alias("o"))).alias("b"))
    return best.join(median, "symbol").select("event_id", (-F.col("b.o")).alias("offset"), (F.col("b.n") >= F.greatest(F.lit(5.0), 3 * F.col("_median"))).alias("echo"))

