"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, joins
from . import views as v
from .views import entry, table, with_views

_VOTES = "votes as (select event_id, label as v1, ['bull', 'bear', 'neutral'][k % 2 + 1] as v2, ['bull', 'bear', 'neutral', 'x'][k % 4 + 1] as v3, symbol from m)"


def _votes(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), F.col("k") % n + 1)
    return v.messages(spark, d).select("event_id", F.col("label").alias("v1"), pick(("bull", "bear"), 2).alias("v2"), pick(("bull", "bear", "neutral", "x"), 4).alias("v3"), "symbol")


def _kinds(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("community"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


def _profiled(spark, d):
    text = F.when(F.col("doc_id") % 11 == 0, "[removed]").otherwise(F.col("text"))
    return table(spark, d, "documents").select("source", (F.col("doc_id") % 97).alias("day"), text.alias("text"), "n_chars", (F.col("doc_id") % 5 == 0).alias("link"))


QUERIES = {
    "d1_count_mentions": entry(lambda s, d: aggregates.count_mentions(table(s, d, "events").select(v.hour("ts").alias("step"), F.array("event_type", "event_type", F.when(F.col("value") > 50, "high")).alias("symbols")).withColumn("symbols", F.filter("symbols", lambda x: x.isNotNull()))),
        "select step, symbol, count(*) as n from (select cast(floor(epoch_us(ts) / 3600000000) as bigint) as step, unnest(case when value > 50 then [event_type, 'high'] else [event_type] end) as symbol from events) group by 1, 2"),
    "d2_add_matrices": entry(lambda s, d: aggregates.add_matrices([v.hourly(s, d), v.hourly(s, d).filter("n > 3")]), with_views("h", "select step, symbol, cast(sum(n) as bigint) as n from (select * from h union all select * from h where n > 3) group by 1, 2")),
    "d3_masters": entry(lambda s, d: aggregates.masters(_kinds(s, d)), "select user_id % 16 as community, event_type as kind, cast(grouping(user_id % 16, event_type) as bigint) as level, count(*) as total from events group by grouping sets ((user_id % 16), (event_type), ())"),
    "d3_conservation": entry(lambda s, d: aggregates.check_conservation(_kinds(s, d)), "select count(*) as by_community, count(*) as by_kind, count(*) as whole, true as holds from events"),
    "d4_ingest_metrics": entry(lambda s, d: aggregates.ingest_metrics(table(s, d, "events"), "event_type", F.dayofmonth("ts") <= 15, F.col("value") < 5, F.when(F.col("value") > 50, F.array((F.col("user_id") % 50).cast("string"), F.lit("high"))).otherwise(F.array((F.col("user_id") % 50).cast("string")))),
        """with u as (select event_type, unnest(case when value > 50 then [(user_id % 50)::varchar, 'high'] else [(user_id % 50)::varchar] end) as k from events where day(ts) <= 15 and value >= 5), m as (select event_type, count(*) as n_mentions, count(distinct k) as n_symbols from u group by 1)
        select e.*, coalesce(n_mentions, 0) as n_mentions, coalesce(n_symbols, 0) as n_symbols from (select event_type, count(*) as n_read, count(*) filter (day(ts) <= 15) as n_in_month, count(*) filter (day(ts) <= 15 and value < 5) as n_removed from events group by 1) e left join m using (event_type)"""),
    "d5_rank_symbols": entry(lambda s, d: aggregates.rank_symbols(v.hourly(s, d)), with_views("h", 'select symbol, count(*) as steps, cast(sum(n) as bigint) as total, max(n) as most, avg(n) as mean, min(step) as "first", max(step) as "last" from h group by 1'), "mean"),
    "d6_describe": entry(lambda s, d: aggregates.describe(table(s, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_totalprice"), "select year, count(*) as n, avg(x) as mean, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q75, quantile_cont(x, 0.9) as q90 from (select year(o_orderdate) as year, o_totalprice as x from orders) group by rollup (year)", "mean q25 median q75 q90"),
    "d7_top_share": entry(lambda s, d: aggregates.top_share(table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")), "l_suppkey", "q"), "select l_suppkey, q, row_number() over (order by q desc, l_suppkey) as place, sum(q) over (order by q desc, l_suppkey rows unbounded preceding) / sum(q) over () as share from (select l_suppkey, sum(l_quantity) as q from lineitem group by 1)", "q share"),
    "d8_daily_sentiment": entry(lambda s, d: aggregates.daily_sentiment(v.messages(s, d)), with_views("m", """select symbol, step, count(*) as n, count(*) filter (label = 'bull') as m_bull, count(*) filter (label = 'bear') as m_bear, count(*) filter (label = 'neutral') as m_neutral,
        sum(p_bull) as s_bull, sum(p_bear) as s_bear, cast(sum(p_neutral) as double) as s_neutral from m group by 1, 2"""), "s_bull s_bear s_neutral"),
    "d9_latest_and_trailing": entry(lambda s, d: aggregates.latest_and_trailing(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 10, 3), """select o_custkey, max(x) filter (r = 1) as latest, avg(x) filter (r <= 3) as mean_short, avg(x) as mean_long from (select o_custkey, o_totalprice as x, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 10 group by 1""", "latest mean_short mean_long"),
    "d10_removal_rates": entry(lambda s, d: aggregates.removal_rates(_removed(s, d), ["community", "month"], "removed", "n"), "select user_id % 16 as community, week(ts) as month, sum((value < 20)::int) / count(*) as rate, count(*) as n from events group by 1, 2", "rate"),
    "d10_weighted_rate": entry(lambda s, d: aggregates.weighted_rate(_removed(s, d).groupBy("symbol", "community").agg(F.sum("n").alias("n")), aggregates.removal_rates(_removed(s, d).filter("community <> 3"), ["community"], "removed", "n"), ["symbol"], ["community"], 0.2),
        """with r as (select user_id % 16 as c, round(sum((value < 20)::int) / count(*), 6) as rate from events where user_id % 16 <> 3 group by 1) select event_type as symbol, sum(coalesce(rate, 0.2)) / count(*) as expected_rate from events left join r on c = user_id % 16 group by 1""", "expected_rate"),
    "d11_confusion": entry(lambda s, d: aggregates.confusion(_votes(s, d), "v1", "v3"), with_views("m", f", {_VOTES} select v1, v3, count(*) as n from votes group by cube (v1, v3)")),
    "d11_agreement": entry(lambda s, d: aggregates.agreement_summary(_votes(s, d), "v1", "v2", "bull", "bear"), with_views("m", f", {_VOTES} select count(*) as n, avg((v1 = v2)::int) as agreement, count(*) filter (v1 in ('bull', 'bear') and v2 in ('bull', 'bear') and v1 <> v2) as inversions from votes"), "agreement"),
    "d12_consensus": entry(lambda s, d: aggregates.consensus(_votes(s, d), "event_id", ["v1", "v2", "v3"], "v1", ["bear", "bull", "neutral"]), with_views("m", f""", {_VOTES}, c as (select event_id, v1, l, count(*) as n from (select event_id, v1, unnest([v1, v2, v3]) as l from votes) where l <> 'x' group by 1, 2, 3), b as (select event_id, v1, max(n) as top from c group by 1, 2),
        t as (select b.event_id, b.v1, b.top, count(*) as k, min(l) as l from b join c on c.event_id = b.event_id and c.n = b.top group by 1, 2, 3) select event_id, case when k > 1 then v1 else l end as consensus, top as votes, k > 1 as tie from t""")),
    "d13_leaderboard": entry(lambda s, d: aggregates.leaderboard(_votes(s, d), "v1", ["v2", "v3"], "symbol"), with_views("m", f", {_VOTES}, x as (select symbol, v1, 'v2' as model, v2 as vote from votes union all select symbol, v1, 'v3', v3 from votes) select model, symbol, avg((vote = v1)::int) as accuracy, count(*) as n from x group by grouping sets ((model, symbol), (model))"), "accuracy"),
    "d14_classification_report": entry(lambda s, d: aggregates.classification_report(_votes(s, d), "v1", "v3"), with_views("m", f""", {_VOTES} select label, support, case when predicted > 0 then tp / predicted end as precision, case when support > 0 then tp / support end as recall, 2 * tp / (predicted + support) as f1 from (
        select label, count(*) filter (v1 = label and v3 = label) as tp, count(*) filter (v1 = label) as support, count(*) filter (v3 = label) as predicted from votes, (select unnest(['bull', 'bear', 'neutral', 'x']) as label) group by 1) where support + predicted > 0"""), "precision recall f1"),
    "d14_coverage_curve": entry(lambda s, d: aggregates.coverage_curve(v.messages(s, d).withColumn("pred", F.when(F.col("p_bull") > 0.25, "bull").otherwise("bear")).withColumn("p", F.greatest("p_bull", "p_bear")), "label", "pred", "p", [0.25, 0.3, 0.4, 0.45]), with_views("m", """select cast(threshold as double) as threshold, avg((p >= threshold)::int) as coverage, avg(case when p >= threshold then (label = pred)::int end) as accuracy
        from (select label, case when p_bull > 0.25 then 'bull' else 'bear' end as pred, greatest(p_bull, p_bear) as p from m), (select unnest([0.25::double, 0.3, 0.4, 0.45]) as threshold) group by 1"""), "coverage accuracy"),
    "d15_collect_states": entry(lambda s, d: aggregates.collect_states(table(s, d, "orders"), "o_custkey", "o_orderstatus"), "select o_custkey, string_agg(distinct o_orderstatus, '|' order by o_orderstatus) as states, count(distinct o_orderstatus) > 1 as mixed from orders group by 1"),
    "d16_audit_keys": entry(lambda s, d: aggregates.audit_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "select cast(sum(n) as bigint) as \"rows\", count(*) as keys, count(*) filter (n > 1) as repeated_keys, max(n) as most from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)"),
    "d17_stance_ratio": entry(lambda s, d: aggregates.stance_ratio(v.messages(s, d), ["symbol"], "label", "bull", "bear"), with_views("m", "select symbol, count(*) filter (label = 'bull') as n_bull, count(*) filter (label = 'bear') as n_bear, count(*) filter (label = 'bull') / count(*) filter (label = 'bear') as ratio, count(*) filter (label = 'neutral') / count(*) as neutral_share from m group by 1"), "ratio neutral_share"),
    "d18_coverage": entry(lambda s, d: aggregates.coverage(table(s, d, "customer"), table(s, d, "orders").filter(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("n")), "c_custkey"),
        """select state, n, n / sum(n) over () as share from (select case when x is null then 'missing' when x = 0 then 'silent' else 'covered' end as state, count(*) as n from customer left join (select o_custkey, sum((o_orderstatus = 'F')::int) as x from orders where year(o_orderdate) = 1996 group by 1) on o_custkey = c_custkey group by 1)""", "share"),
    "d19_rescale_mass": entry(lambda s, d: aggregates.rescale_mass(v.hourly(s, d).withColumn("n", F.col("n") * F.col("n")), v.hourly(s, d)), with_views("h", "select symbol, step, n * n * (select sum(n) from h) / (select sum(n * n) from h) as n from h"), "n"),
    "d20_sample_median": entry(lambda s, d: aggregates.sample_median(table(s, d, "events"), "event_type", ["ts", "event_id"], "value", 100), "select event_type, median(value) as median, count(*) as used from (select *, row_number() over (partition by event_type order by ts, event_id) as r from events) where r <= 100 group by 1", "median"),
    "d21_source_profile": entry(lambda s, d: aggregates.source_profile(_profiled(s, d), "source", "day", "text", "n_chars", F.col("link")), """select source, count(*) as "rows", min(day) as first_day, max(day) as last_day, 100 * avg((text is null or length(text) = 0)::int) as pct_empty, 100 * avg(coalesce(text = '[removed]', false)::int) as pct_removed, 100 * avg(link::int) as pct_link,
        100 * avg((not link and not coalesce(text = '[removed]', false))::int) as pct_usable, 100 * avg((length(text) >= 500)::int) as pct_long, median(n_chars) as median_score, count(*) / (max(day) - min(day) + 1) as rows_per_day
        from (select source, doc_id % 97 as day, case when doc_id % 11 = 0 then '[removed]' else text end as text, n_chars, doc_id % 5 = 0 as link from documents) group by 1""", "pct_empty pct_removed pct_link pct_usable pct_long median_score rows_per_day"),
    "c10_weekly_share": entry(lambda s, d: joins.event_rollup(v.dense(s, d), v.events(s, d)), with_views("cat", 'select c.event_id, cast(sum(h.n) as bigint) as total, count(h.n) as steps from cat c join dense h on h.symbol = c.symbol and h.step between c.start and c."end" group by 1')),
    "d13_pairwise_agreement": entry(lambda s, d: aggregates.pairwise_agreement(_votes(s, d), ["v1", "v2", "v3"]), with_views("m", f""", {_VOTES} select 'v1' as a, 'v2' as b, count(*) as n, avg((v1 = v2)::int) as agreement from votes union all select 'v1', 'v3', count(*), avg((v1 = v3)::int) from votes union all select 'v2', 'v3', count(*), avg((v2 = v3)::int) from votes"""), "agreement"),
    "d14_summary": entry(lambda s, d: aggregates.classification_summary(_votes(s, d), "v1", "v3"), with_views("m", f""", {_VOTES}, r as (select label, count(*) filter (v1 = label and v3 = label) as tp, count(*) filter (v1 = label) as support, count(*) filter (v3 = label) as predicted from votes, (select unnest(['bull', 'bear', 'neutral', 'x']) as label) group by 1)
        select cast(sum(support) as bigint) as n, sum(tp) / sum(support) as accuracy, avg(2 * tp / (predicted + support)) as macro_f1, avg(tp / support) filter (support > 0) as balanced_accuracy from r where support + predicted > 0"""), "accuracy macro_f1 balanced_accuracy"),
    "d14_class_weights": entry(lambda s, d: aggregates.class_weights(_votes(s, d), "v3"), with_views("m", f", {_VOTES} select v3, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*)) as weight from votes group by 1"), "weight"),
}


def _removed(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 16).alias("community"), F.weekofyear("ts").alias("month"), F.col("event_type").alias("symbol"), (F.col("value") < 20).cast("int").alias("removed"), F.lit(1).alias("n"))
