"""Queries of the windows, time series and detector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, detector, joins, series
from . import views as v
from .views import PARAMS, entry, with_views


def _state(spark, d):
    cat = v.catalog(spark, d)
    return detector.detector_daily(cat, v.dense(spark, d), PARAMS)


_STATE_SQL = """st as (select *, greatest(mu0 + sigma0, 0.25 * running_peak) as threshold from (
    select c.event_id, c.symbol, c.start, c."end" as event_end, c.mu0, c.sigma0, d.step, d.n, max(d.n) over w as running_peak, sum(d.n) over w as cumulative
    from cat c join dense d on d.symbol = c.symbol and d.step between c.start and (case when c.censored then c."end" else c."end" + 3 end) window w as (partition by c.event_id order by d.step)))"""

_SPANS = """sp as (select o_custkey as entity, o_orderpriority as symbol, cast(o_orderdate as date) as start, cast(o_orderdate as date) + 30 as "end", o_orderkey as key from orders)"""
_LIVES7 = _SPANS + """, blk as (select *, sum(fresh) over (partition by entity order by start, "end", symbol) as block from (select *, case when lag(symbol) over w is null or lag(symbol) over w <> symbol
    or date_diff('day', lag("end") over w, start) > 7 then 1 else 0 end as fresh from sp window w as (partition by entity order by start, "end", symbol))),
    lf as (select entity, cast(block as bigint) as block, min(symbol) as symbol, min(start) as start, max("end") as "end", count(*) as spans from blk group by 1, 2)"""


def _spans(spark, d):
    day = F.to_date("o_orderdate")
    return v.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("symbol"), day.alias("start"), F.date_add(day, 30).alias("end"), F.col("o_orderkey").alias("key"))


def _lives7(spark, d):
    return series.consolidate_lives(_spans(spark, d), "entity")


def _totals(spark, d, year):
    o = v.table(spark, d, "orders").filter(F.year("o_orderdate") == year)
    return o.groupBy(F.col("o_custkey").alias("symbol")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_GRID = {
    "base": PARAMS,
    "kappa_low": detector.Params(**{**PARAMS.__dict__, "kappa": 0.1}),
    "kappa_high": detector.Params(**{**PARAMS.__dict__, "kappa": 0.5}),
    "z_low": detector.Params(**{**PARAMS.__dict__, "z_on": 1.5}),
    "z_high": detector.Params(**{**PARAMS.__dict__, "z_on": 2.5}),
    "cuts": detector.Params(**{**PARAMS.__dict__, "min_steps": 4, "min_total": 30}),
    "robust": detector.Params(**{**PARAMS.__dict__, "robust": True}),
}
#: The episode whose length is compared across scenarios.
_EPISODE = ("click", 473435)


def _scenario(name, p):
    """SQL for the events of one scenario: the views with its parameters, and with its baseline where that is robust."""
    sql = with_views("cat", f"""select '{name}' as scenario, symbol, start, "end", censored, mu0, sigma0, z0, duration, cast(total as bigint) as total, principal from cat""")
    for old, new in (("r.z >= 2.0", f"r.z >= {p.z_on}"), ("0.25 * greatest(w.peak", f"{p.kappa} * greatest(w.peak"), (">= 2 and p.total >= 10 as principal", f">= {p.min_steps} and p.total >= {p.min_total} as principal")):
        assert old in sql
        sql = sql.replace(old, new)
    if p.robust:
        sql = sql.replace("avg(n) over w", "quantile_cont(n, 0.5) over w").replace("stddev_samp(n) over w", "(quantile_cont(n, 0.75) over w - quantile_cont(n, 0.25) over w) / 1.349")
    return f"select * from ({sql})"


def _scenarios():
    return " union all ".join(_scenario(name, p) for name, p in _GRID.items())


def _weighted(spark, d):
    """The dense series with one symbol at half its weight, on the scale of the original."""
    dense = v.dense(spark, d)
    return aggregates.rescale_mass(dense.withColumn("n", F.col("n") * F.when(F.col("symbol") == "error", 0.5).otherwise(1.0)), dense)


def _twins(spark, d):
    """Pairs of symbols, named by a rule on their names."""
    a, b = (v.hourly(spark, d).select(F.col("symbol").alias(n)).distinct() for n in "ab")
    return a.join(b, (F.substring("a", 1, 1) != F.substring("b", 1, 1)) & (F.length("a") <= F.length("b")) & (F.col("a") < F.col("b")))


def _named_twins(spark, d):
    """Supplier groups whose names agree once case and legal forms are gone."""
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*(F.lit(n) for n in ("Alpha", "Beta", "Gamma", "Delta", "Omega"))), (k % 5 + 1).cast("int"))
    form = F.element_at(F.array(*(F.lit(n) for n in (" Inc", " CORP.", ", Ltd", ""))), (k % 4 + 1).cast("int"))
    registry = v.table(spark, d, "supplier").select(F.concat(F.lit("S"), (k % 20).cast("string")).alias("symbol"), F.concat(name, form).alias("name"))
    l = v.table(spark, d, "lineitem")
    step = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    counts = l.groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), step.alias("step")).agg(F.count("*").alias("n"))
    return detector.twin_audit(joins.densify(counts), joins.name_pairs(registry))


_ARC = with_views("p", """, y as (select symbol, step, ret / 10000 as ret, row_number() over w = 1 as f, ln(1 + greatest(coalesce(ret / 10000, 0.0), -0.999)) as y from p window w as (partition by symbol order by step)),
    i as (select *, {where} (100 * exp(sum({x}) over (partition by symbol order by step)) - 100) as x from y)
    select symbol, max(x) as highest, arg_max(x, step) as "last", case when max(x) > 0 then (max(x) - arg_max(x, step)) / max(x) end as given_back, avg(case when f then null when ret > 0 then 1 when ret <= 0 then 0 end) as up_share from i group by symbol""")


QUERIES = {
    "e1_baseline": entry(lambda s, d: series.baseline(v.dense(s, d), 24, 12), with_views("dense", """select symbol, step, n, case when count(n) over w >= 12 then avg(n) over w end as mu, case when count(n) over w >= 12 then stddev_samp(n) over w end as sigma
        from dense window w as (partition by symbol order by step rows between 24 preceding and 1 preceding)"""), "mu sigma"),
    "e2_baseline_robust": entry(lambda s, d: series.baseline_robust(v.dense(s, d), 24, 12), with_views("dense", """select symbol, step, n, case when count(n) over w >= 12 then quantile_cont(n, 0.5) over w end as mu,
        case when count(n) over w >= 12 then (quantile_cont(n, 0.75) over w - quantile_cont(n, 0.25) over w) / 1.349 end as sigma from dense window w as (partition by symbol order by step rows between 24 preceding and 1 preceding)"""), "mu sigma"),
    "e3_zscore": entry(lambda s, d: detector.scored(v.dense(s, d), PARAMS), with_views("z", "select * from z"), "mu sigma z"),
    "e4_bands": entry(lambda s, d: series.bands(v.dense(s, d)), with_views("dense", """select symbol, step, n, case when count(n) over w = 15 then (n > avg(n) over w + stddev_samp(n) over w)::int + (n > avg(n) over w + 2 * stddev_samp(n) over w)::int
        + (n > avg(n) over w + 3 * stddev_samp(n) over w)::int end as band from dense window w as (partition by symbol order by step rows between 14 preceding and current row)""")),
    "e5_runs": entry(lambda s, d: series.runs(v.dense(s, d).withColumn("flag", F.col("n") >= 4), "flag"), with_views("dense", """select symbol, min(step) as start, max(step) as "end", count(*) as length, max(n) as peak
        from (select *, step - row_number() over (partition by symbol order by step) as g from dense where n >= 4) group by symbol, g""")),
    "e6_event_state": entry(lambda s, d: _state(s, d).select("event_id", "step", "n", "running_peak", "threshold", "cumulative", "below"), with_views("cat", "").rstrip() + ", " + _STATE_SQL + """
        select event_id, step, n, running_peak, threshold, cast(cumulative as bigint) as cumulative, step - coalesce(max(case when n >= threshold then step end) over (partition by event_id order by step), start - 1) as below from st""", "threshold"),
    "e7_consolidate_lives": entry(_lives7, f"with {_LIVES7} select * from lf"),
    "e8_life_links": entry(lambda s, d: series.life_links(_lives7(s, d), "entity"), f"""with {_LIVES7} select l.*, lag(symbol) over w as previous, lead(symbol) over w as next, lead(symbol) over w is null as is_last, u.n > 1 as reused
        from lf l join (select symbol, count(distinct entity) as n from lf group by 1) u using (symbol) window w as (partition by entity order by block)"""),
    "e9_detector_covariates": entry(lambda s, d: series.detector_covariates(_state(s, d)), with_views("cat", "").rstrip() + ", " + _STATE_SQL + """
        select event_id, step, lag(c) over w as log_change_lag, lag(n / threshold) over w as to_threshold_lag, lag(n / running_peak) over w as to_peak_lag
        from (select *, ln(1 + n) - ln(1 + lag(n) over (partition by event_id order by step)) as c from st) window w as (partition by event_id order by step)""", "log_change_lag to_threshold_lag to_peak_lag"),
    "e10_adjust_splits": entry(lambda s, d: series.adjust_splits(v.prices(s, d).withColumn("ret", F.col("ret") * 0.5)).select("symbol", "step", "split", F.log("factor").alias("log_factor")), with_views("p", """,
        q as (select symbol, step, close, ret * 0.5 as ret, lag(close) over (partition by symbol order by step) as b from p), sp as (select *, case when b > 0 and close > 0 and ret > -1 and abs(close / (b * (1 + ret)) - 1) > 0.2
        then close / (b * (1 + ret)) else 1.0 end as split from q) select symbol, step, split, sum(ln(split)) over (partition by symbol order by step) as log_factor from sp"""), "split log_factor"),
    "e11_price_arc": entry(lambda s, d: series.price_arc(v.prices(s, d).withColumn("ret", F.col("ret") / 10000)), _ARC.format(x="case when f then 0.0 else y end", where=""), '"last" highest given_back up_share'),
    "e11_price_arc_before": entry(lambda s, d: series.price_arc(v.prices(s, d).withColumn("ret", F.when(F.col("symbol") > "S15", F.coalesce("ret", F.lit(0.5))).otherwise(F.col("ret")) / 10000), "before"), _ARC.format(x="case when symbol > 'S15' and f then ln(1.00005) else y end", where="case when symbol > 'S15' then 1 end *"), '"last" highest given_back up_share'),
    "e12_top1_per_group": entry(lambda s, d: series.top1_per_group(v.catalog(s, d), "symbol", [F.col("total"), -F.col("start")], ["event_id", "total"]), with_views("cat", "select symbol, event_id, cast(total as bigint) as total from (select *, row_number() over (partition by symbol order by total desc, start) as r from cat) where r = 1")),
    "e13_rank_jump": entry(lambda s, d: series.rank_jump(_totals(s, d, 1996), _totals(s, d, 1997), "symbol", "total"), """with a as (select o_custkey as symbol, rank() over (order by round(sum(o_totalprice), 2) desc) as rank_a from orders where year(o_orderdate) = 1996 group by 1),
        b as (select o_custkey as symbol, rank() over (order by round(sum(o_totalprice), 2) desc) as rank_b from orders where year(o_orderdate) = 1997 group by 1)
        select coalesce(a.symbol, b.symbol) as symbol, rank_a, rank_b, rank_a - rank_b as jump from a full join b on a.symbol = b.symbol"""),
    "e14_eligibility": entry(lambda s, d: series.eligibility(_state(s, d), PARAMS.min_total), with_views("cat", "").rstrip() + ", " + _STATE_SQL + """
        select *, case when reaches_total is not null and known_duration is not null then greatest(reaches_total, known_duration) end as eligible from (select event_id, min(case when cumulative >= 10 then step end) as reaches_total,
        min(case when step - start + 1 >= 2 and n >= threshold then step end) as known_duration from st where step <= event_end group by event_id)"""),
    "e15_qcut": entry(lambda s, d: series.qcut(v.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")),
        """with e as (select list_distinct([quantile_cont(o_totalprice, 0.1), quantile_cont(o_totalprice, 0.2), quantile_cont(o_totalprice, 0.3), quantile_cont(o_totalprice, 0.4), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.6),
        quantile_cont(o_totalprice, 0.7), quantile_cont(o_totalprice, 0.8), quantile_cont(o_totalprice, 0.9)]) as q from orders)
        select cast(len(list_filter(q, lambda x: x < o_totalprice)) + 1 as bigint) as bin, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from orders, e group by 1""", "low high"),
    "e16_group_max": entry(lambda s, d: series.with_group_max(v.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice"), "select o_orderkey, o_custkey, o_totalprice, max(o_totalprice) over (partition by o_custkey) as o_totalprice_max from orders", "o_totalprice o_totalprice_max"),
    "e17_resample": entry(lambda s, d: series.resample(v.table(s, d, "lineitem"), "l_shipdate", "week", "l_quantity", ["l_returnflag"]), "select l_returnflag, cast(date_trunc('week', l_shipdate) as timestamp) as period, sum(l_quantity) as total, count(*) as n from lineitem group by 1, 2", "total"),
    "e18_anchor_rescale": entry(lambda s, d: series.anchor_rescale(v.table(s, d, "lineitem").groupBy(F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("batch"), F.col("l_returnflag").alias("symbol"), F.year("l_shipdate").alias("step")).agg(F.sum("l_quantity").alias("n")), "A", "B1"),
        """with b as (select 'B' || l_linenumber as batch, l_returnflag as symbol, year(l_shipdate) as step, sum(l_quantity) as n from lineitem group by 1, 2, 3), r as (select x.batch, sum(y.n) / sum(x.n) as ratio from b x join b y on y.batch = 'B1' and y.symbol = 'A' and y.step = x.step where x.symbol = 'A' group by 1)
        select batch, symbol, cast(step as integer) as step, n * coalesce(ratio, 1.0) as n from b left join r using (batch)""", "n"),
    "e19_curve_audit": entry(lambda s, d: series.curve_audit(v.dense(s, d), "symbol", "step", "n"), with_views("dense", "select symbol, step, n, lag(n) over w as before, coalesce(n < 0.7 * lag(n) over w, false) as falls from dense window w as (partition by symbol order by step)")),
    "e19_longest_consistent": entry(lambda s, d: series.longest_consistent(v.table(s, d, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("x")), "o_custkey", "m", "x")),
    "e20_near_duplicates": entry(lambda s, d: series.near_duplicates(v.table(s, d, "orders").groupBy(F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.sum("o_totalprice").alias("x")), "o_custkey", "m", "x"),
        """with p as (select o_custkey, strftime(o_orderdate, '%Y-%m') as m, sum(o_totalprice) as x from orders group by 1, 2) select a.o_custkey as a, b.o_custkey as b, count(*) as steps from p a join p b on a.m = b.m and a.o_custkey < b.o_custkey
        and abs(a.x - b.x) <= 0.005 * greatest(a.x, b.x) group by 1, 2"""),
    "e21_topk": entry(lambda s, d: series.topk(v.table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", "o_totalprice"),
    "e22_distribution": entry(lambda s, d: series.distribution(v.table(s, d, "lineitem"), "l_returnflag", "l_extendedprice"), """select l_returnflag, count(*) as n, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) as sd,
        (avg(l_extendedprice ** 3) - 3 * avg(l_extendedprice) * avg(l_extendedprice ** 2) + 2 * avg(l_extendedprice) ** 3) / stddev_pop(l_extendedprice) ** 3 as skew from lineitem group by 1""", "mean sd skew"),
    "e22_histogram": entry(lambda s, d: series.histogram(v.table(s, d, "lineitem"), "l_extendedprice", 0.1, log=True), "select cast(floor(log10(1 + l_extendedprice) / 0.1) as bigint) as bin, count(*) as n from lineitem group by 1"),
    "f1_detect": entry(lambda s, d: detector.detect(detector.scored(v.dense(s, d), PARAMS), PARAMS), with_views("found", "select * from found"), "mu0 sigma0 z0"),
    "f1_detect_in_pandas": entry(lambda s, d: detector.detect_in_pandas(detector.scored(v.dense(s, d), PARAMS), PARAMS), with_views("found", "select * from found"), "mu0 sigma0 z0"),
    "f2_merge_close": entry(lambda s, d: detector.merge_close(detector.detect(detector.scored(v.dense(s, d), PARAMS), PARAMS), PARAMS.gap), with_views("merged", "select * from merged"), "mu0 sigma0 z0"),
    "f3_candidates": entry(lambda s, d: detector.candidates(v.dense(s, d), 9), with_views("dense", "select * from dense where symbol in (select symbol from dense group by symbol having max(n) >= 9)")),
    "f4_catalog": entry(v.catalog, with_views("cat", "select * replace (cast(total as bigint) as total) from cat"), "mu0 sigma0 z0 amplitude"),
    "f5_sweep": entry(lambda s, d: detector.sweep(v.dense(s, d), _GRID), "select * from (" + _scenarios() + ")", "mu0 sigma0 z0"),
    "f5_sweep_base": entry(lambda s, d: detector.sweep(v.dense(s, d), _GRID).filter("scenario = 'base'").select("symbol", "start", "end", "duration", F.col("total").cast("long").alias("total"), "principal"),
        with_views("cat", """select symbol, start, "end", duration, cast(total as bigint) as total, principal from cat""")),
    "f6_compare_scenarios": entry(lambda s, d: detector.compare_scenarios(detector.sweep(v.dense(s, d), _GRID), "base", _EPISODE), "with ev as (select * from (" + _scenarios() + f""") where principal), a as (select symbol, start as s, "end" as e from ev where scenario = 'base'),
        met as (select ev.scenario, a.symbol, a.s, arg_min(abs(ev."end" - ev.start - (a.e - a.s)), ev.start) as d from a join ev on ev.symbol = a.symbol and ev.start <= a.e and ev."end" >= a.s group by 1, 2, 3), f as (select scenario, count(*) as r, median(d) as d from met group by 1)
        select scenario, n_events, n_symbols, n_censored, median_duration, p90_duration, longest, episode_duration, coalesce(r, 0) / (select count(*) from a) as recovered_share, d as median_difference from (select scenario, count(*) as n_events, count(distinct symbol) as n_symbols, count(*) filter (censored) as n_censored,
        median("end" - start + 1) as median_duration, quantile_cont("end" - start + 1, 0.9) as p90_duration, max("end" - start + 1) as longest, arg_min("end" - start + 1, start) filter (symbol = '{_EPISODE[0]}' and {_EPISODE[1]} between start and "end") as episode_duration from ev group by 1) left join f using (scenario)""", "median_duration p90_duration recovered_share median_difference"),
    "f7_detector_daily": entry(lambda s, d: _state(s, d).select("event_id", "step", "age", "phase", "n", "running_peak", "threshold", "cumulative"), with_views("cat", "").rstrip() + ", " + _STATE_SQL + """
        select event_id, step, step - start + 1 as age, case when step <= event_end then 'event' else 'confirmation' end as phase, n, running_peak, threshold, cast(cumulative as bigint) as cumulative from st""", "threshold"),
    "f8_eligibility_table": entry(lambda s, d: detector.eligibility_table(v.catalog(s, d), _state(s, d), PARAMS), with_views("cat", "").rstrip() + ", " + _STATE_SQL + """,
        k as (select event_id, min(case when cumulative >= 10 then step end) as reaches_total, min(case when step - start + 1 >= 2 and n >= threshold then step end) as known_duration from st where step <= event_end group by event_id)
        select c.event_id, c.symbol, c.start, c."end", c.censored, c.n_merged, k.reaches_total, k.known_duration, case when reaches_total is not null and known_duration is not null then greatest(reaches_total, known_duration) end as eligible,
        case when not c.censored then c."end" + 3 end as confirmed, case when reaches_total is not null and known_duration is not null then greatest(reaches_total, known_duration) end = c."end" as dies_on_eligibility from cat c left join k using (event_id)"""),
    "f9_weighted_events": entry(lambda s, d: detector.detect(detector.scored(_weighted(s, d), PARAMS), PARAMS), with_views("found", "select * from found").replace("dense as (", """raw as (""", 1).replace("based as (", """dense as (select symbol, step, n * case when symbol = 'error' then 0.5 else 1.0 end * (select sum(n) from raw) / (select sum(n * case when symbol = 'error' then 0.5 else 1.0 end) from raw) as n from raw), based as (""", 1), "mu0 sigma0 z0"),
    "f10_band_bubbles": entry(lambda s, d: detector.band_bubbles(v.dense(s, d)), with_views("dense", """, b as (select symbol, step, n, case when count(n) over w = 15 then (n > avg(n) over w + 2 * stddev_samp(n) over w) else false end as f from dense window w as (partition by symbol order by step rows between 14 preceding and current row))
        select symbol, min(step) as start, max(step) as "end", count(*) as length, max(n) as peak from (select *, step - row_number() over (partition by symbol order by step) as g from b where f) group by symbol, g""")),
    "f11_fact_profile": entry(lambda s, d: detector.fact_profile(v.table(s, d, "events").filter("value > 99").select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("symbol"), v.hour("ts").alias("step")), v.dense(s, d)),
        with_views("dense", "select e.event_id as fact_id, d.step - e.s as \"offset\", d.n from (select event_id, event_type, cast(floor(epoch_us(ts) / 3600000000) as bigint) as s from events where value > 99) e join dense d on d.symbol = e.event_type and d.step between e.s - 7 and e.s + 7")),
    "f12_twin_audit": entry(lambda s, d: detector.twin_audit(v.dense(s, d), v.hourly(s, d).select(F.col("symbol").alias("a")).distinct().crossJoin(v.hourly(s, d).select(F.col("symbol").alias("b")).distinct()).filter("a < b")),
        with_views("dense", "select x.symbol as a, y.symbol as b, corr(x.n, y.n) as corr, corr(ln(1 + x.n), ln(1 + y.n)) as log_corr, avg((x.n > 0 and y.n > 0)::int) as both_positive from dense x join dense y on x.step = y.step and x.symbol < y.symbol group by 1, 2"), "corr log_corr both_positive"),
    "f12_named_pairs": entry(_named_twins, """with r as (select distinct 'S' || (s_suppkey % 20) as symbol, ['ALPHA', 'BETA', 'GAMMA', 'DELTA', 'OMEGA'][s_suppkey % 5 + 1] as name from supplier), k as (select distinct a.symbol as a, b.symbol as b from r a join r b on a.name = b.name and a.symbol < b.symbol),
        h as (select 'S' || (l_suppkey % 20) as symbol, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as step, count(*) as n from lineitem group by 1, 2),
        dense as (select s.symbol, g.step, coalesce(h.n, 0) as n from (select distinct symbol from h) s cross join (select unnest(range(lo, hi + 1)) as step from (select min(step) as lo, max(step) as hi from h)) g left join h on h.symbol = s.symbol and h.step = g.step)
        select k.a, k.b, corr(x.n, y.n) as corr, corr(ln(1 + x.n), ln(1 + y.n)) as log_corr, avg((x.n > 0 and y.n > 0)::int) as both_positive from k join dense x on x.symbol = k.a join dense y on y.symbol = k.b and y.step = x.step group by 1, 2""", "corr log_corr both_positive"),
    "attention_catalog": entry(lambda s, d: detector.catalog(joins.densify(v.table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.floor(v.hour("ts") / 6).alias("step")).agg(F.count("*").alias("n"))),
        detector.Params(window=20, least=10, z_on=1.5, min_abs=3, k_off=2, gap=2, min_steps=2, min_total=6))),
    "e7_clipped_lives": entry(lambda s, d: series.consolidate_lives(_spans(s, d), "entity", 7, "1996-01-01", "1997-12-31", ["key"]), f"""with {_LIVES7} select entity, cast(block as bigint) as block, min(symbol) as symbol, min(greatest(start, date '1996-01-01')) as start, max(least("end", date '1997-12-31')) as "end", count(*) as spans, arg_max(key, (start, "end", key)) as key from blk group by 1, 2"""),
    "e8_rename_chains": entry(lambda s, d: series.rename_chains(_lives7(s, d), "entity"), f"""with {_LIVES7}, f as (select *, lag(symbol) over (partition by entity order by block) as b from lf) select entity, string_agg(symbol, '>' order by block) filter (b is null or b <> symbol) as chain, min(start) as earliest, count(*) filter (b <> symbol) as renames from f group by 1"""),
    "f9_compare_catalogs": entry(lambda s, d: detector.compare_catalogs(v.catalog(s, d), detector.catalog(_weighted(s, d), PARAMS))),
    "f10_bubble_cover": entry(lambda s, d: detector.bubble_cover(v.catalog(s, d), detector.band_bubbles(v.dense(s, d))), with_views("cat", """, b as (select symbol, step, case when count(n) over w = 15 then (n > avg(n) over w + 2 * stddev_samp(n) over w) else false end as f from dense window w as (partition by symbol order by step rows between 14 preceding and current row))
        select count(*) as events, count(*) filter (c) as covered, count(*) filter (c) / count(*) as share from (select exists (select 1 from b where f and b.symbol = cat.symbol and b.step between cat.start and cat."end") as c from cat)"""), "share"),
    "f12_twin_events": entry(lambda s, d: detector.twin_events(v.catalog(s, d), _twins(s, d)), with_views("cat", """, t as (select distinct x.symbol as a, y.symbol as b from h x join h y on x.symbol[1] <> y.symbol[1] and length(x.symbol) <= length(y.symbol) and x.symbol < y.symbol)
        select t.a, t.b, count(x.start) filter (y.start is not null) as overlapping from t left join cat x on x.symbol = t.a left join cat y on y.symbol = t.b and x.start <= y."end" and x."end" >= y.start group by 1, 2""")),
}
