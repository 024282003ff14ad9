"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from . import views as v
from .views import entry, table, with_views

_SHIFT = 'b as (select symbol, start + 1 as start, "end" + 2 as "end" from cat where start % 3 <> 0)'


def _shifted(spark, d):
    return v.events(spark, d).filter("start % 3 <> 0").select("symbol", (F.col("start") + 1).alias("start"), (F.col("end") + 2).alias("end"))


def _items(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), F.date_add(F.to_date("o_orderdate"), 3).alias("day"))


def _names(spark, d):
    p = table(spark, d, "benchmark")
    first = F.regexp_extract("text", r"^\W*(\w+ \w+)", 1)
    return p.select(F.col("item_id").cast("string").alias("symbol"), first.alias("name")).filter("name <> ''").groupBy("name").agg(F.min("symbol").alias("symbol"))


def _announcements(spark, d):
    return table(spark, d, "events").filter("value > 90").select(F.col("event_type").alias("symbol"), v.hour("ts").alias("step")).distinct()


def _fuzzy(spark, d, odd):
    c = table(spark, d, "customer").filter(F.col("c_custkey") % 2 == odd)
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.substring("c_name", 15, 4)).alias("name"), F.col("c_acctbal").alias("value"))


def _named_fuzzy(spark, d, odd):
    """Few candidates a key: customers by nation and the last digits of their number."""
    key = F.concat_ws("-", "nation", F.floor(F.col("id") / 2) % 50)
    return _fuzzy(spark, d, odd).withColumn("nation", key).withColumn("name", F.concat("name", F.lit(" Holdings, Inc.; class A")))


QUERIES = {
    "c1_enrich": entry(lambda s, d: joins.enrich(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), ["o_custkey"]), "select o_custkey, o_orderkey, c_mktsegment, c_nationkey from orders left join customer on c_custkey = o_custkey"),
    "c2_complete_cases": entry(lambda s, d: joins.complete_cases(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").withColumn("toxic", F.when(F.col("toxic") == 0, 0)), ["doc_id"], ["quality", "toxic"]), "select doc_id, lang, quality, toxic from documents join labels using (doc_id) where toxic = 0 and quality is not null"),
    "c3_diff_tables": entry(lambda s, d: joins.diff_tables(table(s, d, "orders").filter("o_orderkey % 5 <> 0"), table(s, d, "orders").filter("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).groupBy("side").agg(F.count("*").alias("n"), F.sum("differs_o_orderstatus").alias("status"), F.sum("differs_o_totalprice").alias("price")),
        """select side, count(*) as n, cast(sum(s) as bigint) as status, cast(sum(p) as bigint) as price from (select case when b.k is null then 'left_only' when a.k is null then 'right_only' else 'both' end as side, (a.x is distinct from b.x)::bigint as s, (a.y is distinct from b.y)::bigint as p
        from (select o_orderkey as k, o_orderstatus as x, o_totalprice as y from orders where o_orderkey % 5 <> 0) a full join (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as x, o_totalprice as y from orders where o_orderkey % 7 <> 0) b on a.k = b.k) group by 1"""),
    "c4_semi": entry(lambda s, d: joins.semi(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), ["doc_id"]), "select doc_id, source from documents where doc_id in (select doc_id from labels)"),
    "c4_anti": entry(lambda s, d: joins.anti(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), ["doc_id"]), "select doc_id, source from documents where doc_id not in (select doc_id from labels)"),
    "c5_link_with_fallback": entry(lambda s, d: joins.link_with_fallback(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), table(s, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ref")), table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("ref")), "l_partkey", "l_suppkey", "ref"),
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_brand, s_name) as ref, case when p_brand is not null then 'l_partkey' when s_name is not null then 'l_suppkey' else 'none' end as link from lineitem
        left join (select * from part where p_size < 20) on p_partkey = l_partkey left join (select * from supplier where s_acctbal > 0) on s_suppkey = l_suppkey"""),
    "c6_valid_on": entry(lambda s, d: joins.valid_on(_items(s, d), v.lives(s, d), "entity", "day", "start", "end", "2002-01-01"), with_views("lives", """select o_custkey as entity, o_orderkey as id, cast(o_orderdate as date) + 3 as day, start, coalesce("end", date '2002-01-01') as "end", state
        from orders join lives on entity = o_custkey and cast(o_orderdate as date) + 3 between start and coalesce("end", date '2002-01-01')""")),
    "c7_overlap": entry(lambda s, d: joins.overlap_join(v.events(s, d), _shifted(s, d), "symbol"), with_views("cat", "").rstrip() + f', {_SHIFT} select a.symbol, a.start as a_start, a."end" as a_end, b.start as b_start, b."end" as b_end, b.start - a.start as start_delta from cat a left join b on a.symbol = b.symbol and a.start <= b."end" and a."end" >= b.start'),
    "c8_messages_in_windows": entry(lambda s, d: joins.messages_in_windows(v.messages(s, d).select("event_id", "symbol", "step"), v.events(s, d), 3, 3), with_views("cat m", 'select event_id, symbol, step from m where exists (select 1 from cat c where c.symbol = m.symbol and m.step between c.start - 3 and c."end" + 3)')),
    "c9_assign_event": entry(lambda s, d: joins.assign_event(v.messages(s, d).select(F.col("event_id").alias("message"), "symbol", "step"), v.events(s, d), ["message"]), with_views("cat m", 'select m.event_id as message, arg_min(c.event_id, c.start) as event_id from m join cat c on c.symbol = m.symbol and m.step between c.start and c."end" group by 1')),
    "c10_event_rollup": entry(lambda s, d: joins.event_rollup(v.hourly(s, d), v.events(s, d)), with_views("cat", 'select c.event_id, cast(coalesce(sum(h.n), 0) as bigint) as total, count(h.n) as steps from cat c left join h on h.symbol = c.symbol and h.step between c.start and c."end" group by 1')),
    "c11_contains_join": entry(lambda s, d: joins.contains_join(table(s, d, "documents"), _names(s, d), "doc_id", "text"), r"""with n as (select min(symbol) as symbol, name from (select cast(item_id as varchar) as symbol, regexp_extract(text, '^[^a-zA-Z0-9_]*([a-zA-Z0-9_]+ [a-zA-Z0-9_]+)', 1) as name from benchmark) where name <> '' group by name),
        nn as (select symbol, ' ' || trim(regexp_replace(regexp_replace(upper(name), '&|\bAND\b', ' ', 'g'), '\s+', ' ', 'g')) || ' ' as k from n), t as (select doc_id, ' ' || trim(regexp_replace(regexp_replace(upper(text), '&|\bAND\b', ' ', 'g'), '\s+', ' ', 'g')) || ' ' as k from documents)
        select distinct doc_id, symbol from t join nn on contains(t.k, nn.k)"""),
    "c12_asof_value": entry(lambda s, d: joins.asof_value(v.events(s, d), v.hourly(s, d).select("symbol", "step", F.when(F.col("n") % 2 == 0, F.col("n")).alias("close"))), with_views("cat", "select c.event_id, arg_max(h.n, h.step) as close_at_peak from cat c left join h on h.symbol = c.symbol and h.step between c.start and c.peak and h.n % 2 = 0 group by 1")),
    "c13_lagged": entry(lambda s, d: joins.lagged(v.hourly(s, d), "symbol", "step", ["n"], 2), with_views("h", "select a.symbol, a.step, b.n as n_lag from h a join h b on a.symbol = b.symbol and b.step = a.step - 2")),
    "c14_match_nearest": entry(lambda s, d: joins.match_catalogs(v.events(s, d), _shifted(s, d), "nearest")),
    "c15_match_overlap": entry(lambda s, d: joins.match_catalogs(v.events(s, d), _shifted(s, d), "overlap")),
    "c16_anchor_facts": entry(lambda s, d: joins.anchor_facts(v.messages(s, d).filter("value > 99").select(F.col("event_id").alias("fact_id"), "symbol", "step"), v.events(s, d)), with_views("cat m", """, c as (select m.event_id as fact_id, cat.event_id, cat.start, case when cat.event_id is null then 2 when m.step between cat.start and cat."end" then 0 else 1 end as r from m left join cat
        on cat.symbol = m.symbol and (m.step between cat.start and cat."end" or (cat.start > m.step and cat.start <= m.step + 10)) where m.value > 99) select fact_id, event_id, ['inside', 'next', 'none'][r + 1] as rule from (select *, row_number() over (partition by fact_id order by r, start, event_id) as k from c) where k = 1""")),
    "c17_announcements": entry(lambda s, d: joins.label_announcements(v.events(s, d), _announcements(s, d)), with_views("cat", """select symbol, start, event_id, peak, "end", censored, cast(exists (select 1 from events e where e.value > 90 and e.event_type = cat.symbol and abs(cast(floor(epoch_us(ts) / 3600000000) as bigint) - cat.start) <= 2) as integer) as announced from cat""")),
    "c18_fuzzy_link": entry(lambda s, d: joins.fuzzy_link(_fuzzy(s, d, 0), _fuzzy(s, d, 1), "nation"), """with c as (select c_nationkey as nation, c_custkey as id, c_mktsegment || ' ' || substring(c_name, 15, 4) as name, c_acctbal as value from customer),
        r as (select a.id as a_id, b.id as b_id, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) as s, abs(a.value - b.value) as x from c a join c b on a.nation = b.nation and a.id % 2 = 0 and b.id % 2 = 1)
        select a_id, b_id, s as similarity, case when s >= 0.8 then 'high' when s >= 0.5 then 'middle' else 'low' end as tier from (select *, row_number() over (partition by a_id order by s desc, x, b_id) as k from r) where k = 1""", "similarity"),
    "c19_apply_patches": entry(lambda s, d: joins.apply_patches(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), table(s, d, "customer").filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 5).alias("c_custkey"), F.lit("PATCHED").alias("c_mktsegment")).union(table(s, d, "customer").select((F.max("c_custkey") + 1), F.lit("NEW"))), "c_custkey"),
        """with p as (select c_custkey + 5 as k, 'PATCHED' as m from customer where c_custkey % 10 = 0 union all select max(c_custkey) + 1, 'NEW' from customer) select coalesce(c_custkey, k) as c_custkey, coalesce(m, c_mktsegment) as c_mktsegment, c_acctbal from customer full join p on k = c_custkey""", "c_acctbal"),
    "c20_diff_registry": entry(lambda s, d: joins.diff_registry(table(s, d, "orders").filter(F.year("o_orderdate") == 1996).select("o_custkey").distinct(), table(s, d, "orders").filter(F.year("o_orderdate") == 1997).select("o_custkey").distinct(), "o_custkey"),
        """with a as (select distinct o_custkey from orders where year(o_orderdate) = 1996), b as (select distinct o_custkey from orders where year(o_orderdate) = 1997) select o_custkey, 'new' as change from b where o_custkey not in (select o_custkey from a) union all select o_custkey, 'missing' from a where o_custkey not in (select o_custkey from b)"""),
    "c21_union_blocks": entry(lambda s, d: joins.union_blocks([table(s, d, "orders").filter("o_orderkey % 2 = 0").select("o_custkey", F.to_date("o_orderdate").alias("day")), table(s, d, "orders").filter("o_orderkey % 2 = 1").select("o_custkey", F.to_date("o_orderdate").alias("day"))], ["o_custkey", "day"]), "select o_custkey, cast(o_orderdate as date) as day, count(*) over (partition by o_custkey, cast(o_orderdate as date)) as times from orders"),
    "c22_densify": entry(v.dense, with_views("dense", "select * from dense")),
    "c23_pair_overlap": entry(lambda s, d: joins.pair_overlap(v.messages(s, d).filter("label = 'bull'").select("symbol", "step"), v.messages(s, d).filter("label = 'bear'").select("symbol", "step")), with_views("m", """, a as (select distinct symbol, step from m where label = 'bull'), b as (select distinct symbol, step from m where label = 'bear'), x as (select count(*) as n from (select * from a intersect select * from b))
        select (select count(*) from a) as n_a, (select count(*) from b) as n_b, x.n as n_both, (select count(*) from a) - x.n as only_a, (select count(*) from b) - x.n as only_b, (select count(*) from (select * from a union select * from b)) as n_union, x.n / (select count(*) from a) as reproduced from x"""), "reproduced"),
    "c24_recover_ids": entry(lambda s, d: joins.recover_ids(table(s, d, "documents").select("lang", "source", "text"), table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text"), ["lang", "source"], "text"), """with k as (select lang, source, substring(text, 1, 50) as p, min(doc_id) as id from documents group by 1, 2, 3 having count(*) = 1) select d.lang, d.source, k.id from documents d left join k on k.lang = d.lang and k.source = d.source and k.p = substring(d.text, 1, 50)"""),
    "l7_reproduction_rate": entry(lambda s, d: joins.pair_overlap(v.events(s, d).select("symbol", "start"), _shifted(s, d).select("symbol", (F.col("start") - 1).alias("start"))), with_views("cat", """select count(*) as n_a, count(*) filter (start % 3 <> 0) as n_b, count(*) filter (start % 3 <> 0) as n_both, count(*) filter (start % 3 = 0) as only_a, 0 as only_b, count(*) as n_union, count(*) filter (start % 3 <> 0) / count(*) as reproduced from cat"""), "reproduced"),
    "c18_fuzzy_link_names": entry(lambda s, d: joins.fuzzy_link_names(_named_fuzzy(s, d, 0), _named_fuzzy(s, d, 1), "nation")),
}
