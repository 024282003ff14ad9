"""Queries of the stance panels, market covariates and news labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates, joins, panel, series
from . import views as v
from .views import entry, table, with_views

_CONFUSION = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.15, 0.15, 0.7]]


def daily(spark, d):
    return aggregates.daily_sentiment(v.messages(spark, d))


def panel_of(spark, d):
    return panel.sentiment_panel(v.events(spark, d), daily(spark, d), 3, 3)


def start_stop(spark, d, **more):
    return panel.start_stop(panel_of(spark, d), v.catalog(spark, d), **more)


_PANEL = """ds as (select symbol, step, count(*) as n, count(*) filter (label = 'bull') as m_bull, count(*) filter (label = 'bear') as m_bear, sum(p_bull) as s_bull, sum(p_bear) as s_bear from m group by 1, 2),
    pn as (select c.event_id, c.symbol, c.start, c."end", c.censored, g.step, g.step - c.start as age, case when g.step < c.start then 'pre' when g.step > c."end" then 'post' else 'event' end as phase, coalesce(ds.n, 0) as n, coalesce(m_bull, 0) as m_bull,
    coalesce(m_bear, 0) as m_bear, ln((1 + coalesce(m_bull, 0)) / (1 + coalesce(m_bear, 0))) as b, case when m_bull + m_bear > 0 then 1 - abs(m_bull - m_bear) / (m_bull + m_bear) end as d,
    ln((1 + coalesce(s_bull, 0)) / (1 + coalesce(s_bear, 0))) as b_prob from cat c, lateral (select unnest(range(c.start - 3, c."end" + 4)) as step) g left join ds on ds.symbol = c.symbol and ds.step = g.step)"""
_SS = _PANEL + """, ss as (select a.event_id, a.symbol, a.age as start, a.age + 1 as stop, (a.step = a."end" and not a.censored)::int as death, p.b as b_lag, coalesce(p.d, 0.5) as d_lag, (p.d is null)::int as silent_lag, ln(1 + p.n) as log_n_lag, a.step
    from pn a join pn p on p.event_id = a.event_id and p.step = a.step - 1 where a.phase = 'event')"""


def _cat_m(body: str) -> str:
    return with_views("cat m", "").rstrip() + ", " + body


def _price_events(spark, d):
    """The weeks of highest volume of each supplier group as events on the price calendar."""
    p = v.prices(spark, d)
    top = series.top1_per_group(p, "symbol", [F.col("volume"), -F.col("step")], ["step"])
    return top.select(F.concat_ws("_", "symbol", (F.col("step") - 3).cast("string")).alias("event_id"), "symbol", (F.col("step") - 3).alias("start"), F.col("step").alias("peak"), (F.col("step") + 3).alias("end"), F.lit(False).alias("censored"))


_PEV = """pe as (select symbol || '_' || (step - 3) as event_id, symbol, step - 3 as start, step as peak, step + 3 as "end" from (select *, row_number() over (partition by symbol order by volume desc, step) as r from p) where r = 1)"""


def _press(spark, d):
    return joins.densify(v.messages(spark, d).filter("label = 'neutral'").groupBy("symbol", "step").agg(F.count("*").alias("n")))


_PRESS = """pr0 as (select symbol, step, count(*) as n from m where label = 'neutral' group by 1, 2), pr as (select s.symbol, g.step, coalesce(x.n, 0) as n from (select distinct symbol from pr0) s cross join (select unnest(range(lo, hi + 1)) as step from (select min(step) as lo, max(step) as hi from pr0)) g
    left join pr0 x on x.symbol = s.symbol and x.step = g.step)"""

def _adjusted_sql() -> str:
    """The counts by the inverse of the transposed matrix, spelled out; the inverse of these fixed values is a constant."""
    inverse = np.linalg.inv(np.array(_CONFUSION).T)
    names = ("m_bull", "m_bear", "m_neutral")
    raw = ", ".join("greatest(" + " + ".join(f"{c} * ({inverse[i, j]!r}::double)".replace("np.float64(", "(") for j, c in enumerate(names)) + f", 0.0) as r{i}" for i in range(3))
    out = ", ".join(f"case when r0 + r1 + r2 > 0 then r{i} * (m_bull + m_bear + m_neutral) / (r0 + r1 + r2) else 0.0 end as {c}_adjusted" for i, c in enumerate(names))
    counts = ", ".join(f"count(*) filter (label = '{c[2:]}') as {c}" for c in names)
    return with_views("m", f", c as (select symbol, step, {counts} from m group by 1, 2), x as (select *, {raw} from c) select symbol, step, m_bull, m_bear, m_neutral, {out} from x")


_ADJUSTED = _adjusted_sql()


def _covered(spark, d):
    events = v.catalog(spark, d)
    frontier = panel.coverage_frontier(events.select("event_id", "symbol", "start", "end"), v.messages(spark, d).filter("k < 90").select("symbol", "step"))
    return panel.start_stop_covered(panel_of(spark, d), events, frontier)


def _perturbed(spark, d):
    """Twenty redrawn panels in which the bullish class is recognised less often on days of high volume."""
    rows = panel.with_strata(panel_of(spark, d))
    weak = {"high": panel.degraded(_CONFUSION, 0, 0.7)}
    return panel.perturb_counts(rows, ["event_id", "step"], ["m_bull", "m_bear", "m_neutral"], _CONFUSION, 20, strata="volume", matrices=weak)


def _hierarchy(spark, d):
    """Announced events first, then those of a symbol without dated announcements, then by the press."""
    events = v.events(spark, d)
    dates = table(spark, d, "events").filter("value > 90").select(F.col("event_type").alias("symbol"), v.hour("ts").alias("step")).distinct()
    prior = joins.label_announcements(events, dates).select("event_id", F.when(F.col("announced") == 1, "earnings").when(F.col("symbol") == "error", "undated").alias("prior"))
    return panel.label_institutional(events, _press(spark, d), prior=prior).select("event_id", "label")


def _placed(spark, d):
    """Suppliers as instruments: two blocks of daily prices (returned lines and the others) under the symbols of lives that overlap."""
    l, k = table(spark, d, "lineitem"), F.col("s_suppkey")
    begin = (8000 + k * 37 % 1500).cast("long")
    lives = table(spark, d, "supplier").select(k.cast("long").alias("instrument"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("symbol"), begin.alias("start"), F.when(k % 5 != 0, begin + 800 + k % 500).alias("end"))
    step = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    out = []
    for name, mine in (("returned", F.col("l_returnflag") == "R"), ("other", F.col("l_returnflag") != "R")):
        sign = F.when(F.col("l_suppkey") % 2 == 0, -1.0).otherwise(1.0)  # mid quotes carry a minus sign
        prices = l.filter(mine).groupBy(F.col("l_suppkey").cast("long").alias("instrument"), step.alias("step"), sign.alias("_s")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
        out.append(panel.placed_prices(prices.select("instrument", "step", (F.col("close") * F.col("_s")).alias("close"), F.lit(None).cast("double").alias("ret"), "volume"), lives, name, 10600))
    return out


_PLACED = """with lv as (select s_suppkey as instrument, 'S' || (s_suppkey % 7) as symbol, 8000 + s_suppkey * 37 % 1500 as life_start, case when s_suppkey % 5 <> 0 then 8000 + s_suppkey * 37 % 1500 + 800 + s_suppkey % 500 end as life_end from supplier),
    px as (select case when l_returnflag = 'R' then 0 else 1 end as k, l_suppkey as instrument, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as step, sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1, 2, 3),
    placed as (select k, case k when 0 then 'returned' else 'other' end as source, symbol, step, px.instrument, close, volume, life_start from px join lv on lv.instrument = px.instrument and step between life_start and coalesce(life_end, 10600))"""


QUERIES = {
    "h1_bd_index": entry(lambda s, d: daily(s, d).select("symbol", "step", panel.optimism(F.col("m_bull"), F.col("m_bear")).alias("b"), panel.disagreement(F.col("m_bull"), F.col("m_bear")).alias("d")), with_views("m", """select symbol, step, ln((1 + c) / (1 + v)) as b, case when c + v > 0 then 1 - abs(c - v) / (c + v) end as d
        from (select symbol, step, count(*) filter (label = 'bull') as c, count(*) filter (label = 'bear') as v from m group by 1, 2)"""), "b d"),
    "h2_sentiment_panel": entry(lambda s, d: panel_of(s, d).select("event_id", "step", "phase", "age", "n", "m_bull", "m_bear", "b", "d", "b_prob"), _cat_m(_PANEL + " select event_id, step, phase, age, n, m_bull, m_bear, b, d, b_prob from pn"), "b d b_prob"),
    "h3_start_stop": entry(start_stop, _cat_m(_SS + " select * from ss"), "b_lag d_lag log_n_lag"),
    "h4_start_stop_frontier": entry(lambda s, d: start_stop(s, d, frontier=473750), _cat_m(_SS + " select * from ss where step <= 473750"), "b_lag d_lag log_n_lag"),
    "h5_delayed_entry": entry(lambda s, d: panel.delayed_entry(start_stop(s, d), v.catalog(s, d).select("event_id", (F.col("start") + 1).alias("eligible"))).drop("eligible"), _cat_m(_SS + ' select ss.* from ss join cat c on c.event_id = ss.event_id where ss.step > c.start + 1'), "b_lag d_lag log_n_lag"),
    "h6_adjust_counts": entry(lambda s, d: panel.adjust_counts(daily(s, d).select("symbol", "step", "m_bull", "m_bear", "m_neutral"), ["m_bull", "m_bear", "m_neutral"], _CONFUSION), _ADJUSTED, "m_bull_adjusted m_bear_adjusted m_neutral_adjusted"),
    "h7_perturb_counts": entry(lambda s, d: panel.perturb_counts(daily(s, d), ["symbol", "step"], ["m_bull", "m_bear", "m_neutral"], _CONFUSION, 20).select("symbol", "step", "replica", (F.col("m_bull") + F.col("m_bear") + F.col("m_neutral")).alias("total")), with_views("m", "select symbol, step, cast(r as integer) as replica, count(*) as total from m, (select unnest(range(1, 21)) as r) group by 1, 2, 3")),
    "h7_perturb_strata": entry(_perturbed),
    "h7_strata": entry(lambda s, d: panel.with_strata(panel_of(s, d)).select("event_id", "step", "volume", "moment", "side"), _cat_m(_PANEL + """, q as (select quantile_cont(n, 1/3::double) as q1, quantile_cont(n, 2/3::double) as q2 from pn where n > 0)
        select event_id, step, case when n <= q1 then 'low' when n <= q2 then 'middle' else 'high' end as volume, case when age <= 5 then 'early' else 'late' end as moment, case when m_bull >= m_bear then 'bull' else 'bear' end as side from pn, q""")),
    "h8_early_features": entry(lambda s, d: panel.early_features(panel_of(s, d)), _cat_m(_PANEL + " select event_id, avg(b) as early_b, coalesce(avg(d), 0.5) as early_d, (avg(d) is null)::int as early_silent from pn where phase = 'event' and age < 3 group by 1"), "early_b early_d"),
    "p1_price_panel": entry(lambda s, d: joins.union_blocks([v.prices(s, d).filter("step < 9500"), v.prices(s, d).filter("step >= 9500")], ["symbol", "step"]).select("symbol", "step", F.round(F.abs("close") * F.col("volume"), 2).alias("turnover"), "volume", "times"), with_views("p", "select symbol, step, round(abs(close) * volume, 2) as turnover, volume, 1 as times from p"), "turnover volume"),
    "p1_placed_panel": entry(lambda s, d: panel.price_panel(_placed(s, d)), _PLACED + """, r as (select symbol, step, instrument, close, volume, source, row_number() over (partition by symbol, step order by k, life_start desc, instrument) as r, count(*) over (partition by symbol, step) as candidates from placed)
        select symbol, step, instrument, close, cast(null as double) as ret, volume, source, candidates from r where r = 1""", "close volume"),
    "p1_conflicts": entry(lambda s, d: panel.price_conflicts(_placed(s, d)[0]), _PLACED + " select symbol, step, cast(count(distinct instrument) as integer) as n, array_to_string(list_sort(list(distinct instrument)), ',') as instruments from (select * from placed where k = 0) group by 1, 2 having count(distinct instrument) > 1"),
    "p2_price_covariates": entry(lambda s, d: panel.price_covariates(_price_events(s, d), v.prices(s, d)), with_views("p", f""", {_PEV}, x as (select e.event_id, e.start, e.peak, e."end", p.step, p.close, p.volume from pe e join p on p.symbol = e.symbol and p.step between e.start - 30 and e."end" + 5),
        a as (select event_id, peak, count(*) filter (step < start) as pre, count(*) filter (step between start and "end") as ins, arg_max(close, step) filter (step < start) as base, arg_max(close, step) filter (step between start and peak) as atpeak, arg_max(close, step) filter (step between start and "end") as atend,
        max(close) filter (step between start and "end") as top, avg(volume) filter (step < start) as vpre, avg(volume) filter (step between start and "end") as vin from x group by 1, 2), g as (select event_id, step as s from (select *, row_number() over (partition by event_id order by close desc, step) as r from x where step >= start - 5) where r = 1)
        select event_id, case when ok then atpeak / base - 1 end as ret_to_peak, case when ok then atend / atpeak - 1 end as ret_peak_to_end, case when ok then top / base - 1 end as ret_max, case when ok then vin / vpre end as volume_ratio, case when ok then s - peak end as price_lag from (select *, pre >= 5 and ins >= 2 as ok from a) join g using (event_id)"""), "ret_to_peak ret_peak_to_end ret_max volume_ratio"),
    "p3_peak_lag": entry(lambda s, d: panel.peak_lag(_price_events(s, d), v.prices(s, d), 7), with_views("p", f", {_PEV} select event_id, step - peak as lag from (select e.event_id, e.peak, p.step, row_number() over (partition by e.event_id order by p.close desc, p.step) as r from pe e join p on p.symbol = e.symbol and p.step between e.peak - 7 and e.peak + 7) where r = 1")),
    "p4_missing_price_causes": entry(lambda s, d: panel.missing_price_causes(_price_events(s, d).withColumn("symbol", F.when(F.col("peak") % 3 == 0, F.concat(F.lit("X"), F.col("symbol"))).otherwise(F.col("symbol"))), v.prices(s, d)), with_views("p", f", {_PEV} select event_id, 'never_priced' as cause from pe where peak % 3 = 0")),
    "p5_instrument_at": entry(lambda s, d: panel.instrument_at(v.lives(s, d).select(F.concat_ws("_", "entity", "start").alias("event_id"), F.col("entity").alias("symbol"), F.date_sub("start", 10).alias("start")), v.lives(s, d).select(F.col("entity").alias("symbol"), "start", F.coalesce("end", F.lit("2002-01-01").cast("date")).alias("end"), F.col("state").alias("instrument"))),
        with_views("lives", """, l as (select *, coalesce("end", date '2002-01-01') as e2 from lives), x as (select a.entity || '_' || a.start as event_id, b.start as f, b.state, case when a.start - 10 between b.start and b.e2 then 0 else 1 end as late from l a join l b on a.entity = b.entity)
        select event_id, state as instrument, late = 0 as valid_then from (select *, row_number() over (partition by event_id order by late, f, state) as r from x) where r = 1""")),
    "p6_life_snapshot": entry(lambda s, d: panel.life_snapshot(v.lives(s, d).select(F.col("entity").alias("symbol"), "start", F.coalesce("end", F.lit("2002-01-01").cast("date")).alias("end")), table(s, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.last_day("o_orderdate").alias("month")).agg(F.max("o_totalprice").alias("close"), F.count("*").alias("volume"))),
        with_views("lives", """, mo as (select o_custkey as symbol, last_day(cast(o_orderdate as date)) as month, max(o_totalprice) as close, count(*) as volume from orders group by 1, 2)
        select l.entity as symbol, l.start, max(month) as last_month, arg_max(close, month) as last_close, avg(close * volume * 100) / 21 as dollar_volume from lives l join mo on mo.symbol = l.entity and mo.month between l.start and coalesce(l."end", date '2002-01-01') group by 1, 2"""), "last_close dollar_volume"),
    "p7_compare_covariates": entry(lambda s, d: panel.compare_covariates(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("x")), table(s, d, "lineitem").filter("l_linenumber < 5").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("x")), "l_orderkey", ["q", "x"]),
        """with a as (select l_orderkey, sum(l_quantity) as q, sum(l_extendedprice) as x from lineitem group by 1), b as (select l_orderkey, sum(l_quantity) as q, sum(l_extendedprice) as x from lineitem where l_linenumber < 5 group by 1),
        u as (select 'q' as covariate, a.q as va, b.q as vb from a join b using (l_orderkey) union all select 'x', a.x, b.x from a join b using (l_orderkey)) select covariate, count(*) as n, count(*) filter (abs(va - vb) < 1e-9) as equal, corr(va, vb) as corr, avg(abs(va - vb)) as mean_difference from u group by 1""", "corr mean_difference"),
    "w1_census_compare": entry(lambda s, d: panel.census_compare(v.dense(s, d), _press(s, d)), with_views("dense m", f""", {_PRESS}, x as (select a.symbol, a.step, a.n as na, b.n as nb from dense a join pr b on a.symbol = b.symbol and a.step = b.step)
        select symbol, corr(ln(1 + na), ln(1 + nb)) as log_corr, arg_max(step, na * 1000000000 - step) = arg_max(step, nb * 1000000000 - step) as same_peak from x group by 1"""), "log_corr"),
    "w2_label_institutional": entry(lambda s, d: panel.label_institutional(v.events(s, d), _press(s, d)), _cat_m(_PRESS + """, a as (select c.event_id, count(*) filter (pr.step <= c.start - 3) as k, median(pr.n) filter (pr.step <= c.start - 3) as med, max(pr.n) filter (pr.step <= c.start - 3) as bm, max(pr.n) filter (pr.step >= c.start - 2) as pk
        from cat c join pr on pr.symbol = c.symbol and pr.step between c.start - 32 and c.start + 2 group by 1), x as (select c.event_id, coalesce(k >= 15 and pk is not null, false) as ok, med, bm, pk from cat c left join a using (event_id))
        select event_id, case when ok then pk >= greatest(5, 3 * med) end as echo, case when ok then pk >= greatest(15, 3 * med) end as floor, case when ok then pk >= greatest(5, 3 * med) and pk >= 2 * bm end as main,
        case when not ok then 'uncovered' when pk >= greatest(5, 3 * med) and pk >= 2 * bm then 'institutional' else 'native' end as label from x""")),
    "w2_hierarchy": entry(_hierarchy, _cat_m(_PRESS + """, a as (select c.event_id, count(*) filter (pr.step <= c.start - 3) as k, median(pr.n) filter (pr.step <= c.start - 3) as med, max(pr.n) filter (pr.step <= c.start - 3) as bm, max(pr.n) filter (pr.step >= c.start - 2) as pk
        from cat c join pr on pr.symbol = c.symbol and pr.step between c.start - 32 and c.start + 2 group by 1), x as (select c.*, coalesce(k >= 15 and pk is not null, false) as ok, med, bm, pk from cat c left join a using (event_id)),
        an as (select distinct event_type as symbol, cast(floor(epoch_us(ts) / 3600000000) as bigint) as step from events where value > 90)
        select event_id, case when exists (select 1 from an where an.symbol = x.symbol and abs(an.step - x.start) <= 2) then 'earnings' when x.symbol = 'error' then 'undated' when not ok then 'uncovered' when pk >= greatest(5, 3 * med) and pk >= 2 * bm then 'institutional' else 'native' end as label from x""")),
    "w3_press_echo": entry(lambda s, d: panel.press_echo(v.events(s, d), _press(s, d)), _cat_m(_PRESS + """, md as (select symbol, median(n) as med from pr group by 1) select event_id, o as "offset", n >= greatest(5, 3 * med) as echo from (select c.event_id, c.symbol, pr.n, pr.step - c.peak as o,
        row_number() over (partition by c.event_id order by pr.n desc, abs(pr.step - c.peak), pr.step - c.peak) as r from cat c join pr on pr.symbol = c.symbol and pr.step between c.peak - 5 and c.peak + 5) join md using (symbol) where r = 1""")),
    "h4_coverage_frontier": entry(lambda s, d: panel.coverage_frontier(v.events(s, d), v.messages(s, d).filter("k < 90").select("symbol", "step")), with_views("cat m", """, f as (select c.event_id, c.start, c."end", coalesce(min(case when p.step is null then g.step end) - 1, c."end") as frontier from cat c, lateral (select unnest(range(c.start, c."end" + 1)) as step) g
        left join (select distinct symbol, step + 1 as step from m where k < 90) p on p.symbol = c.symbol and p.step = g.step group by 1, 2, 3) select event_id, frontier, frontier < "end" as truncated from f where frontier >= start""")),
    "h4_start_stop_covered": entry(_covered, _cat_m(_SS + """, f as (select c.event_id, coalesce(min(case when p.step is null then g.step end) - 1, c."end") as frontier from cat c, lateral (select unnest(range(c.start, c."end" + 1)) as step) g
        left join (select distinct symbol, step + 1 as step from m where k < 90) p on p.symbol = c.symbol and p.step = g.step group by c.event_id, c."end") select ss.* from ss join f on f.event_id = ss.event_id where ss.step <= f.frontier"""), "b_lag d_lag log_n_lag"),
}
