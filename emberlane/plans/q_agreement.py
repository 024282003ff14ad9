"""Queries of resampling, agreement, event studies, figures and expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, joins, series, survival
from ..sources.store import stored
from . import q_panel
from . import views as v
from .views import entry, table, with_views

_M2 = "m2 as (select *, case when p_bull > 0.3 then 'bull' when p_bull < 0.2 then 'bear' else 'neutral' end as other from m)"


def _two(spark, d):
    return v.messages(spark, d).withColumn("other", F.when(F.col("p_bull") > 0.3, "bull").when(F.col("p_bull") < 0.2, "bear").otherwise("neutral"))


def _pair(spark, d):
    return agreement.paired_series(v.events(spark, d), v.dense(spark, d), q_panel._press(spark, d), 3)


def _paths(spark, d):
    return v.events(spark, d).join(joins.event_steps(v.events(spark, d)).join(v.dense(spark, d), ["symbol", "step"]).select("event_id", "step", F.col("n").alias("value")), "event_id").select("event_id", (F.col("step") - F.col("start")).alias("age"), "value")


def _clusters(spark, d):
    """Clusters drawn 200 times, from their sums; the mean of each replica."""
    rows = v.durations(spark, d).select("cluster", F.lit(1).alias("n"), "t")
    return agreement.bootstrap_cluster_sums(rows, "cluster", ["n", "t"], 200).select("replica", "n", (F.col("t") / F.col("n")).alias("mean_t"))


def _permuted(spark, d):
    """The correlation of durations with a covariate against 500 permutations of it."""
    rows = stored(v.durations(spark, d).select("o_orderkey", "t", "x2"), "durations")
    return agreement.placebo_p(rows.agg(F.corr("t", "x2").alias("statistic")), agreement.placebo_correlations(rows, "o_orderkey", "t", "x2", 500))


def _trajectories(spark, d):
    """The correlation of an event's length with its mean path against 300 exchanges of paths by age."""
    paths = stored(_paths(spark, d), "paths")
    length = paths.groupBy("event_id").agg((F.max("age") + 1).alias("length"))

    def statistic(df, *keys):
        means = df.groupBy(*keys, "event_id").agg(F.avg("value").alias("mean")).join(F.broadcast(length), "event_id")
        return means.groupBy(*keys).agg(F.corr("length", "mean").alias("statistic"))

    return agreement.placebo_p(statistic(paths), statistic(agreement.placebo_trajectory(paths, 300), "replica"))


def _banded(spark, d):
    """The statistic of ``_trajectories`` with donors from the same third of lengths."""
    paths = stored(_paths(spark, d), "paths")
    length = paths.groupBy("event_id").agg((F.max("age") + 1).alias("length"))
    bands = series.qcut(length, "length", 3).select("event_id", F.col("bin").alias("band"))

    def statistic(df, *keys):
        means = df.groupBy(*keys, "event_id").agg(F.avg("value").alias("mean")).join(F.broadcast(length), "event_id")
        return means.groupBy(*keys).agg(F.corr("length", "mean").alias("statistic"))

    return agreement.placebo_p(statistic(paths), statistic(agreement.placebo_trajectory(paths.join(bands, "event_id"), 300, "band"), "replica"))


def _halves(spark, d):
    """Per order the mean quantity of even lines less that of odd ones."""
    odd = F.col("l_linenumber") % 2 == 1
    x = F.round(F.avg(F.when(~odd, F.col("l_quantity"))) - F.avg(F.when(odd, F.col("l_quantity"))), 4)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(x.alias("x")).dropna()


def _sources(spark, d):
    """Optimism of a symbol's hour by two halves of its users."""
    m = v.messages(spark, d)
    side = lambda rest: m.filter(F.col("user_id") % 2 == rest).groupBy("symbol", "step").agg(F.count_if(F.col("label") == "bull").alias("c"), F.count_if(F.col("label") == "bear").alias("v"))
    a, b = side(0).select("symbol", "step", (F.col("c") + F.col("v")).alias("size"), F.log((1 + F.col("c")) / (1 + F.col("v"))).alias("a")), side(1).select("symbol", "step", F.log((1 + F.col("c")) / (1 + F.col("v"))).alias("b"))
    return a.join(b, ["symbol", "step"]).withColumn("day", F.concat_ws("_", "symbol", F.expr("step div 24").cast("string")))


def _signed(spark, d):
    return agreement.sign_agreement(_sources(spark, d), "a", "b", "size", "day", [1, 2, 3, 5], 500)


def _controls(spark, d):
    """Purchases of over 90 as mentions against ignitions, beside as many dates without one."""
    m = v.messages(spark, d).filter("value > 97").select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("source"), "symbol", "step")
    span = v.dense(spark, d).agg(F.min("step").alias("first"), F.max("step").alias("last"))
    return agreement.event_study_controls(m, v.events(spark, d).select("symbol", "start"), span)


def _dual(spark, d):
    rows = agreement.dual_panel(_two(spark, d), ["symbol", "step"], "label", "other")
    other = v.hourly(spark, d).select("symbol", "step", F.col("n").alias("n_other"))
    return agreement.dual_agreement(rows, "symbol", other, ["symbol", "step"])


def _duel(spark, d):
    """Lagged optimism by two classifiers in the same duration model of event steps."""
    dual = agreement.dual_panel(_two(spark, d), ["symbol", "step"], "label", "other").select("symbol", (F.col("step") + 1).alias("step"), "b_a", "b_b")
    rows = q_panel.start_stop(spark, d).join(dual, ["symbol", "step"])
    return survival.registry(spark, agreement.model_duel(rows, ("b_a",), ("b_b",), ("log_n_lag",), "stop", "death", "start"))


QUERIES = {
    "r1_bootstrap_clusters": entry(_clusters),
    "r2_bootstrap_stat": entry(lambda s, d: agreement.bootstrap_stat(v.durations(s, d), "t", 5000)),
    "r3_bootstrap_summary": entry(lambda s, d: agreement.bootstrap_summary(table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("x")), ["l_returnflag"], "x", 0.05), """select *, low > 0.05 or high < 0.05 as excludes from (select l_returnflag, count(x) as n, avg(x) as mean, stddev_samp(x) as se, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.975) as high
        from (select l_returnflag, l_suppkey, avg(l_discount) as x from lineitem group by 1, 2) group by 1)""", "mean se low median high"),
    "r4_placebo_permute": entry(lambda s, d: agreement.placebo_permute(v.durations(s, d), "o_orderkey", "x2", 3).groupBy("replica", F.col("x2_placebo").alias("x2")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids")), with_views("dur", "select cast(r as integer) as replica, x2, count(*) as n, count(distinct o_orderkey) as ids from dur, (select unnest([1, 2, 3]) as r) group by 1, 2")),
    "r4_placebo_p": entry(_permuted),
    "r5_placebo_p": entry(_trajectories),
    "r5_placebo_trajectory": entry(lambda s, d: agreement.placebo_trajectory(_paths(s, d), 5).groupBy("replica").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"), F.count_if(F.col("donor") == F.col("event_id")).alias("own")), with_views("cat", 'select cast(r as integer) as replica, cast(sum(duration) as bigint) as "rows", count(*) as events, 0 as own from cat, (select unnest([1, 2, 3, 4, 5]) as r) group by 1')),
    "r6_sign_counts": entry(lambda s, d: agreement.sign_counts(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))) - F.avg(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))), 4).alias("x")).dropna(), "x"), """with x as (select l_orderkey, round(avg(l_quantity) filter (l_linenumber % 2 = 0) - avg(l_quantity) filter (l_linenumber % 2 = 1), 4) as x from lineitem group by 1), y as (select * from x where x is not null),
        r as (select x, abs(x) as a, (rank() over (order by abs(x)) + rank() over (order by abs(x)) + count(*) over (partition by abs(x)) - 1) / 2 as k from y where x <> 0) select count(*) as n, count(*) filter (x > 0) as n_positive, sum(k) filter (x > 0) as rank_sum, (select avg(x) from y) as mean, (select avg(x) / (stddev_samp(x) / sqrt(count(x))) from y) as t from r""", "rank_sum mean t"),
    "r5_placebo_bands": entry(_banded),
    "r6_paired_tests": entry(lambda s, d: agreement.paired_tests(_halves(s, d), "x")),
    "r6_mcnemar_test": entry(lambda s, d: agreement.mcnemar(_two(s, d).withColumn("b", F.when(F.col("k") % 2 == 0, "bull").otherwise("bear")), "label", "other", "b")),
    "l3_sign_agreement": entry(_signed),
    "l5_controls": entry(_controls),
    "l8_dual_agreement": entry(_dual),
    "l8_model_duel": entry(_duel),
    "r6_mcnemar": entry(lambda s, d: agreement.mcnemar_counts(_two(s, d).withColumn("b", F.when(F.col("k") % 2 == 0, "bull").otherwise("bear")), "label", "other", "b"), with_views("m", f", {_M2}, x as (select label, other, case when k % 2 = 0 then 'bull' else 'bear' end as b from m2) select count(*) filter (label = other and label <> b) as only_a, count(*) filter (label <> other and label = b) as only_b from x")),
    "l1_paired_series": entry(_pair, with_views("cat m", "").rstrip() + f""", {q_panel._PRESS} select c.symbol, g.step, c.event_id, c.start, c."end", coalesce(d.n, 0) as na, coalesce(pr.n, 0) as nb, case when g.step < c.start then 'pre' when g.step > c."end" then 'post' else 'event' end as phase, g.step - c.start as age
        from cat c, lateral (select unnest(range(c.start - 3, c."end" + 4)) as step) g left join dense d on d.symbol = c.symbol and d.step = g.step left join pr on pr.symbol = c.symbol and pr.step = g.step"""),
    "l2_lead_lag": entry(lambda s, d: agreement.lead_lag(v.dense(s, d).withColumnRenamed("n", "na").join(q_panel._press(s, d).withColumnRenamed("n", "nb"), ["symbol", "step"]), "symbol"), with_views("dense m", f""", {q_panel._PRESS}, x as (select a.symbol, a.step, a.n as na, b.n as nb from dense a join pr b on a.symbol = b.symbol and a.step = b.step), c as (select x.symbol, l as lag, round(corr(ln(1 + x.na), ln(1 + y.nb)), 6) as corr from x, (select unnest(range(-3, 4)) as l)
        join x y on y.symbol = x.symbol and y.step = x.step - l group by 1, 2) select symbol, lag as best_lag, corr as best_corr from (select *, row_number() over (partition by symbol order by corr desc, abs(lag), lag desc) as r from c) where r = 1"""), "best_corr"),
    "l3_kappa": entry(lambda s, d: agreement.kappa(_two(s, d), "label", "other"), with_views("m", f""", {_M2}, t as (select count(*) as n, avg((label = other)::int) as o from m2), e as (select sum(a * b) / (select n * n from t) as e from (select label, count(*) as a from m2 group by 1) join (select other as label, count(*) as b from m2 group by 1) using (label))
        select n, o as observed, e as expected, (o - e) / (1 - e) as kappa from t, e"""), "observed expected kappa"),
    "l3_threshold_ladder": entry(lambda s, d: agreement.threshold_ladder(_two(s, d), "label", "other", "value", [0, 20, 60]), with_views("m", f""", {_M2}, x as (select m2.*, th from m2, (select unnest([0, 20, 60]) as th) where value >= th), t as (select th, count(*) as n, avg((label = other)::int) as o from x group by 1),
        e as (select th, sum(a * b) as e from (select th, label, count(*) as a from x group by 1, 2) join (select th, other as label, count(*) as b from x group by 1, 2) using (th, label) group by 1) select th as threshold, n, o as observed, e / (n * n) as expected, (o - e / (n * n)) / (1 - e / (n * n)) as kappa from t join e using (th)"""), "observed expected kappa"),
    "l4_series_agreement": entry(lambda s, d: agreement.series_agreement(_pair(s, d).withColumn("size", F.col("na") + F.col("nb")), "symbol", "na", "nb", "size", 2), with_views("cat m", "").rstrip() + f""", {q_panel._PRESS}, x as (select c.symbol, coalesce(d.n, 0) as na, coalesce(pr.n, 0) as nb from cat c, lateral (select unnest(range(c.start - 3, c."end" + 4)) as step) g
        left join dense d on d.symbol = c.symbol and d.step = g.step left join pr on pr.symbol = c.symbol and pr.step = g.step) select symbol, count(*) as n, round(corr(na, nb), 6) + 0.0 as corr from x where na + nb >= 2 group by rollup (symbol)"""),
    "l5_event_study": entry(lambda s, d: agreement.event_study(table(s, d, "events").filter("value > 80").select((F.col("user_id") % 4).alias("source"), F.col("event_type").alias("symbol"), F.col("event_id").alias("mention_id"), v.hour("ts").alias("step")), v.events(s, d).select("symbol", "start"), v.hourly(s, d).agg((F.max("step") - F.min("step") + 1).alias("steps"))),
        with_views("cat", """, x as (select user_id % 4 as source, event_type as symbol, event_id, cast(floor(epoch_us(ts) / 3600000000) as bigint) as step from events where value > 80), r as (select symbol, least(1.0, count(*) * 5.0 / (select max(step) - min(step) + 1 from h)) as r from cat group by 1)
        select source, count(*) as mentions, cast(sum((exists (select 1 from cat c where c.symbol = x.symbol and c.start between x.step - 1 and x.step + 3))::int) as bigint) as hits, sum(coalesce(r, 0)) as expected from x left join r using (symbol) group by 1"""), "expected"),
    "l6_extrapolate_volume": entry(lambda s, d: agreement.extrapolate_volume(table(s, d, "events"), "event_type", "ts"), "select event_type, count(*) as n, count(*) * 86400 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) as per_day from events group by 1", "per_day"),
    "l8_dual_panel": entry(lambda s, d: agreement.dual_panel(_two(s, d), ["symbol", "step"], "label", "other"), with_views("m", f""", {_M2}, x as (select symbol, step, count(*) as n, ln((1 + count(*) filter (label = 'bull')) / (1 + count(*) filter (label = 'bear'))) as b_a, ln((1 + count(*) filter (other = 'bull')) / (1 + count(*) filter (other = 'bear'))) as b_b from m2 group by 1, 2) select *, abs(b_a - b_b) as difference from x"""), "b_a b_b difference"),
    "q1_figures": entry(lambda s, d: agreement.figure_registry([
        agreement.figure(table(s, d, "orders"), "finished_orders", F.count_if(F.col("o_orderstatus") == "F"), F.count("*"), "orders with status F over all orders"),
        agreement.figure(table(s, d, "labels"), "toxic_share", F.sum("toxic"), F.count("toxic"), "toxic labels over labels"),
    ]), "select 'finished_orders' as figure, 'orders with status F over all orders' as definition, cast(count(*) filter (o_orderstatus = 'F') as double) as numerator, cast(count(*) as double) as denominator, count(*) filter (o_orderstatus = 'F') / count(*) as value from orders union all select 'toxic_share', 'toxic labels over labels', sum(toxic), count(toxic), sum(toxic) / count(toxic) from labels", "numerator denominator value"),
    "q2_expect": entry(lambda s, d: agreement.expect(table(s, d, "lineitem"), {"quantity_positive": F.col("l_quantity") > 0, "discount_low": F.col("l_discount") < 0.08}), "select count(*) as \"rows\", 'quantity_positive' as rule, count(*) filter (not l_quantity > 0) as violations from lineitem union all select count(*), 'discount_low', count(*) filter (not l_discount < 0.08) from lineitem"),
    "q3_flow_table": entry(lambda s, d: agreement.flow_table(table(s, d, "orders"), {"priced": F.col("o_totalprice") > 1000, "finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"}), """select 'imported' as step, count(*) as n from orders union all select 'priced', count(*) from orders where o_totalprice > 1000 union all select 'finished', count(*) from orders where o_totalprice > 1000 and o_orderstatus = 'F'
        union all select 'urgent', count(*) from orders where o_totalprice > 1000 and o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"""),
    "q4_compare_matrices": entry(lambda s, d: agreement.compare_matrices(v.dense(s, d), q_panel._press(s, d)), with_views("dense m", f""", {q_panel._PRESS}, x as (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.n, 0) as na, coalesce(b.n, 0) as nb from dense a full join pr b on a.symbol = b.symbol and a.step = b.step), c as (select symbol, corr(na, nb) as c, sum(na) as ta, sum(nb) as tb from x group by 1)
        select count(*) as symbols, min(c) as lowest, quantile_cont(c, 0.1) as p10, quantile_cont(c, 0.5) as median, cast(sum(ta) as bigint) as total_a, cast(sum(tb) as bigint) as total_b from c"""), "lowest p10 median"),
    "e17_monthly": entry(lambda s, d: series.resample(table(s, d, "orders"), "o_orderdate", "month", "o_totalprice", ["o_orderpriority"]), "select o_orderpriority, cast(date_trunc('month', o_orderdate) as timestamp) as period, sum(o_totalprice) as total, count(*) as n from orders group by 1, 2", "total"),
    "l2_peak_offset": entry(lambda s, d: agreement.peak_offset(_pair(s, d)), with_views("cat m", "").rstrip() + f""", {q_panel._PRESS}, x as (select c.event_id, g.step, coalesce(d.n, 0) as na, coalesce(pr.n, 0) as nb from cat c, lateral (select unnest(range(c.start, c."end" + 1)) as step) g
        left join dense d on d.symbol = c.symbol and d.step = g.step left join pr on pr.symbol = c.symbol and pr.step = g.step), o as (select event_id, count(*) as n, max(nb) as b, (select min(y.step) from x y where y.event_id = x.event_id and y.nb = max(x.nb)) - (select min(y.step) from x y where y.event_id = x.event_id and y.na = max(x.na)) as o from x group by 1)
        select event_id, case when n >= 3 and b > 0 then o end as peak_offset from o"""),
}
