"""Windows and time series: baselines, z-scores, bands, runs, lives, adjustments, arcs, ranks, cuts, resampling.

Series are (symbol, step, n) on a dense integer calendar unless said otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .near import near_pairs
from .ranks import numbered, quantiles


def _order(*keys: str, by: str = "step"):
    return Window.partitionBy(*keys).orderBy(by)


def baseline(series: DataFrame, window: int = 30, least: int = 15) -> DataFrame:
    """Mean and sample deviation of the previous ``window`` steps, null with fewer than ``least``."""
    past = _order("symbol").rowsBetween(-window, -1)
    enough = F.count("n").over(past) >= least
    return series.withColumn("mu", F.when(enough, F.avg("n").over(past))).withColumn("sigma", F.when(enough, F.stddev_samp("n").over(past)))


def _quantile(values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.element_at(values, low + 1) + (at - low) * (F.element_at(values, F.least(low + 2, F.size(values))) - F.element_at(values, low + 1))


def baseline_robust(series: DataFrame, window: int = 30, least: int = 15) -> DataFrame:
    """Median and interquartile range / 1.349 of the previous steps; the frame holds at most ``window`` values."""
    past = _order("symbol").rowsBetween(-window, -1)
    out = series.withColumn("_v", F.array_sort(F.collect_list(F.col("n").cast("double")).over(past)))
    enough = F.size("_v") >= least
    v = F.col("_v")
    out = out.withColumn("mu", F.when(enough, _quantile(v, 0.5))).withColumn("sigma", F.when(enough, (_quantile(v, 0.75) - _quantile(v, 0.25)) / 1.349))
    return out.drop("_v")


def zscore(based: DataFrame) -> DataFrame:
    """Z with the deviation floored by the root of the mean and by 1; null without a baseline."""
    floor = F.greatest("sigma", F.sqrt("mu"), F.lit(1.0))
    return based.withColumn("z", F.when(F.col("mu").isNotNull() & F.col("sigma").isNotNull(), (F.col("n") - F.col("mu")) / floor))


def bands(series: DataFrame, window: int = 15) -> DataFrame:
    """The band (0 to 3 deviations) that a step exceeds, its own value included in a full window."""
    frame = _order("symbol").rowsBetween(1 - window, 0)
    mu, sd = F.avg("n").over(frame), F.stddev_samp("n").over(frame)
    full = F.count("n").over(frame) == window
    over = lambda k: (F.col("n") > mu + k * sd).cast("int")
    return series.withColumn("band", F.when(full, over(1) + over(2) + over(3)))


def runs(flagged: DataFrame, flag: str, value: str = "n") -> DataFrame:
    """E5: maximal runs of flagged steps: start, end, length, peak."""
    on = F.coalesce(F.col(flag), F.lit(False))
    begins = on & ~F.coalesce(F.lag(on).over(_order("symbol")), F.lit(False))
    numbered = flagged.withColumn("_run", F.sum(begins.cast("int")).over(_order("symbol"))).filter(on)
    return numbered.groupBy("symbol", "_run").agg(F.min("step").alias("start"), F.max("step").alias("end"), F.count("*").alias("length"), F.max(value).alias("peak")).drop("_run")


def event_state(rows: DataFrame, kappa: float = 0.25) -> DataFrame:
    """Within an event: running peak, running threshold, running total, length of the current stay below the threshold.

    Rows have event_id, step, n, mu0, sigma0.
    """
    w = _order("event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("running_peak", F.max("n").over(w)).withColumn("cumulative", F.sum("n").over(w))
    out = out.withColumn("threshold", F.greatest(F.col("mu0") + F.col("sigma0"), kappa * F.col("running_peak")))
    last_ok = F.max(F.when(F.col("n") >= F.col("threshold"), F.col("step"))).over(w)
    first = F.min("step").over(Window.partitionBy("event_id"))
    return out.withColumn("below", (F.col("step") - F.coalesce(last_ok, first - 1)).cast("long"))


def consolidate_lives(spans: DataFrame, entity: str, gap: int = 7, low: str | None = None, high: str | None = None, last: list[str] | None = None) -> DataFrame:
    """Spans (entity, symbol, start, end as dates) of one symbol, closer than ``gap`` days, as one life.

    Gaps are those of the spans as given; starts and ends are then clipped to [low, high]. Columns in ``last`` keep the value
    of the block's last span (the largest of equal ones).
    """
    w = Window.partitionBy(entity).orderBy("start", "end", "symbol")
    fresh = F.lag("symbol").over(w).isNull() | (F.lag("symbol").over(w) != F.col("symbol")) | (F.datediff("start", F.lag("end").over(w)) > gap)
    start = F.greatest("start", F.lit(low).cast("date")) if low else F.col("start")
    end = F.least("end", F.lit(high).cast("date")) if high else F.col("end")
    kept = [F.max_by(c, F.struct("start", "end", c)).alias(c) for c in last or []]
    return (
        spans.withColumn("block", F.sum(fresh.cast("int")).over(w).cast("long"))
        .groupBy(entity, "block")
        .agg(F.min("symbol").alias("symbol"), F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("spans"), *kept)
    )


def life_links(lives: DataFrame, entity: str) -> DataFrame:
    """Symbols before and after, whether the life is the last, whether another entity used the symbol."""
    w = Window.partitionBy(entity).orderBy("block")
    users = lives.groupBy("symbol").agg(F.countDistinct(entity).alias("_users"))
    out = lives.withColumn("previous", F.lag("symbol").over(w)).withColumn("next", F.lead("symbol").over(w))
    return out.withColumn("is_last", F.col("next").isNull()).join(users, "symbol").withColumn("reused", F.col("_users") > 1).drop("_users")


def rename_chains(lives: DataFrame, entity: str) -> DataFrame:
    """Per entity the symbols in order joined by '>', the earliest start, and the number of renames.

    An entity has few lives, which bounds the list; a symbol that returns after another is listed again.
    """
    row = F.array_sort(F.collect_list(F.struct("block", "symbol", "start")))
    symbols = F.transform("_l", lambda x: x["symbol"])
    fresh = F.filter(symbols, lambda s, i: (i == 0) | (s != F.get(symbols, i - 1)))
    out = lives.groupBy(entity).agg(row.alias("_l"), F.min("start").alias("earliest"))
    return out.select(entity, F.array_join(fresh, ">").alias("chain"), "earliest", (F.size(fresh) - 1).cast("long").alias("renames"))


def detector_covariates(rows: DataFrame) -> DataFrame:
    """One step's lag of the log change and of the ratios to threshold and running peak (rows of ``event_state``)."""
    w = _order("event_id")
    change = F.log1p("n") - F.log1p(F.lag("n").over(w))
    out = rows.withColumn("_c", change).withColumn("_t", F.col("n") / F.col("threshold")).withColumn("_p", F.col("n") / F.col("running_peak"))
    return out.select("event_id", "step", F.lag("_c").over(w).alias("log_change_lag"), F.lag("_t").over(w).alias("to_threshold_lag"), F.lag("_p").over(w).alias("to_peak_lag"))


def adjust_splits(prices: DataFrame, least: float = 0.2) -> DataFrame:
    """A close that the return does not explain is a split; closes and volumes on the scale of the first day."""
    w = _order("symbol")
    before = F.lag("close").over(w)
    s = F.when((before > 0) & (F.col("close") > 0) & (F.col("ret") > -1), F.col("close") / (before * (1 + F.col("ret"))))
    out = prices.withColumn("split", F.when(F.abs(s - 1) > least, s).otherwise(1.0))
    factor = F.exp(F.sum(F.log("split")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("factor", factor).withColumn("adjusted_close", F.col("close") / F.col("factor")).withColumn("adjusted_volume", F.col("volume") * F.col("factor"))


def price_arc(prices: DataFrame, base: str = "first") -> DataFrame:
    """An index from returns: its highest and last points above 100, the share of the rise given back, share of up days.

    ``base`` "first": 100 is the first row's close, its own return does not count; "before": 100 is the close before it, and a
    symbol whose first return is missing has no arc. Up days are those after the first; missing returns move nothing.
    """
    w = _order("symbol")
    first = F.row_number().over(w) == 1
    move = F.log1p(F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999)))
    used = F.when(first, 0.0).otherwise(move) if base == "first" else move
    out = prices.withColumn("_first", first).withColumn("_x", 100 * F.exp(F.sum(used).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 100)
    if base != "first":
        out = out.withColumn("_x", F.when(F.max(F.when(F.col("_first"), F.col("ret"))).over(Window.partitionBy("symbol")).isNotNull(), F.col("_x")))
    high, end = F.max("_x"), F.max_by("_x", "step")
    return out.groupBy("symbol").agg(high.alias("highest"), end.alias("last"), F.when(high > 0, (high - end) / high).alias("given_back"), F.avg(F.when(~F.col("_first"), (F.col("ret") > 0).cast("int"))).alias("up_share"))


def top1_per_group(rows: DataFrame, key: str, by: list[Column], columns: list[str]) -> DataFrame:
    """The columns of the largest row of each key; the order must leave no ties."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_t")).select(key, "_t.*")


def rank_jump(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Ranks of keys in two lists of totals, and the difference."""
    # equal totals share the first place among them
    first = F.min("_number").over(Window.partitionBy(value)) + 1
    x, y = (numbered(t.select(key, value), F.desc(value)).select(key, first.cast("long").alias(n)) for t, n in ((a, "rank_a"), (b, "rank_b")))
    return x.join(y, key, "full_outer").withColumn("jump", F.col("rank_a") - F.col("rank_b"))


def eligibility(state: DataFrame, total: int, least_steps: int = 2) -> DataFrame:
    """The first step by which an event is known to last ``least_steps`` and has gathered ``total``; both are needed.

    A step counts from the ignition's, which is the first; steps of the confirmation (column ``phase``) are not the event's.
    """
    first = F.min("step").over(Window.partitionBy("event_id"))
    rows = state.withColumn("_age", F.col("step") - first + 1).filter("phase = 'event'")
    out = rows.groupBy("event_id").agg(F.min(F.when(F.col("cumulative") >= total, F.col("step"))).alias("reaches_total"), F.min(F.when((F.col("_age") >= least_steps) & (F.col("n") >= F.col("threshold")), F.col("step"))).alias("known_duration"))
    both = F.col("reaches_total").isNotNull() & F.col("known_duration").isNotNull()
    return out.withColumn("eligible", F.when(both, F.greatest("reaches_total", "known_duration")))


def qcut(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """Quantile bins by exact edges (equal edges fall together, equal values stay together), from 1."""
    edges = sorted(set(quantiles(rows, value, [i / parts for i in range(parts + 1)])))
    inner = edges[1:-1]
    above = sum(((F.col(value) > e).cast("long") for e in inner), F.lit(0).cast("long"))
    return rows.withColumn("bin", F.when(F.col(value).isNotNull(), above + 1))


def with_group_max(rows: DataFrame, key: str, value: str) -> DataFrame:
    """E16"""
    return rows.withColumn(f"{value}_max", F.max(value).over(Window.partitionBy(key)))


def resample(rows: DataFrame, time: str, unit: str, value: str, by: list[str]) -> DataFrame:
    """Sums by a calendar unit."""
    return rows.groupBy(*by, F.date_trunc(unit, F.col(time)).alias("period")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def anchor_rescale(batches: DataFrame, anchor: str, reference: str) -> DataFrame:
    """Each batch scaled by its anchor's sum against the reference batch, over their common steps."""
    a = batches.filter(F.col("symbol") == anchor).select("batch", "step", F.col("n").alias("_n"))
    r = a.filter(F.col("batch") == reference).select("step", F.col("_n").alias("_r"))
    ratio = a.join(r, "step").groupBy("batch").agg(F.try_divide(F.sum("_r"), F.sum("_n")).alias("_ratio"))
    return batches.join(ratio, "batch", "left").select("batch", "symbol", "step", (F.col("n") * F.coalesce("_ratio", F.lit(1.0))).alias("n"))


def curve_audit(points: DataFrame, key: str, step: str, value: str, drop: float = 0.7) -> DataFrame:
    """Points that fall below ``drop`` times the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(step))
    return points.withColumn("before", before).withColumn("falls", F.coalesce(F.col(value) < drop * F.col("before"), F.lit(False)))


def longest_consistent(points: DataFrame, key: str, step: str, value: str, drop: float = 0.7) -> DataFrame:
    """The points of the longest subsequence in which each value is at least ``drop`` times the one before; a curve per key.

    Of equally long ones the one that ends first and goes through the earliest points stays; missing values are no points. A
    curve has one point per step of the calendar, which bounds its list. ``longest`` and ``points`` are the lengths of the
    subsequence and of the curve.
    """

    def consistent(values: np.ndarray) -> list[int]:
        """Positions of the longest such subsequence."""
        length, before = np.ones(len(values), int), np.full(len(values), -1)
        for i in range(1, len(values)):
            able = np.where(values[i] >= drop * values[:i], length[:i], 0)
            if able.max() > 0:
                before[i], length[i] = able.argmax(), able.max() + 1
        at, rows = int(length.argmax()) if len(values) else -1, []
        while at >= 0:
            rows.append(at)
            at = int(before[at])
        return rows[::-1]

    @F.pandas_udf(ArrayType(IntegerType()))
    def kept(curves: pd.Series) -> pd.Series:
        return curves.map(lambda x: consistent(np.asarray(x, float)))

    curves = points.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(step, value))).alias("_c"))
    found = curves.withColumn("_k", kept(F.transform("_c", lambda p: p[value].cast("double"))))
    sizes = [F.size("_k").cast("long").alias("longest"), F.size("_c").cast("long").alias("points")]
    return found.select(key, F.explode(F.transform("_k", lambda i: F.get("_c", i))).alias("_p"), *sizes).select(key, "_p.*", "longest", "points")


def near_duplicates(points: DataFrame, key: str, step: str, value: str, within: float = 0.005) -> DataFrame:
    """Pairs of entities with nearly the same value in the same step, and in how many; zeros meet zeros, and of two
    different negative values neither is near the other. All pairs are returned, so rows grow with the square of the entities
    of a step; what is moved and written before that grows with the points."""
    return near_pairs(points, key, step, value, within)


def topk(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """E21"""
    return rows.orderBy(*order).limit(k)


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Moments."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"), F.round(F.skewness(value), 6).alias("skew"))


def histogram(rows: DataFrame, value: str, width: float, log: bool = False) -> DataFrame:
    """Counts by equal bins, of the value or of log10(1 + value)."""
    x = F.log10(1 + F.col(value)) if log else F.col(value)
    return rows.groupBy(F.floor(x / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
