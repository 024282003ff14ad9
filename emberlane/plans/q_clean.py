"""Queries of the sources, sinks and cleaning functions, over lines and files made from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import joins
from ..sources import posts
from . import views as v
from .views import entry, table, with_views


def _lines(spark, d):
    """Documents as line JSON; every seventeenth line is cut short."""
    doc = table(spark, d, "documents")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") * 3600 + 1704067200).cast("string").alias("created_utc"), F.col("source").alias("subreddit"), F.col("text").alias("body"), F.col("n_chars").alias("score")))
    return doc.select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.substring(record, 1, 20)).otherwise(record).alias("value"))


def _posts(spark, d):
    return posts.parse_posts(_lines(spark, d)).filter("_bad is null")


def _tomb(spark, d):
    text = F.when(F.col("doc_id") % 11 == 0, "[removed]").when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


_TOMB = "t as (select doc_id, case when doc_id % 11 = 0 then '[removed]' when doc_id % 13 = 0 then '' else text end as text from documents)"


def _dates(spark, d):
    day = F.to_date("o_orderdate")
    made = [F.date_format(day, f) for f in ("yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "d/M/yyyy")] + [F.lit("no date")]
    return table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*made), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("s"))


def _subtitles(spark, d):
    c = table(spark, d, "conversations").withColumn("w", F.element_at(F.split("text", " "), 1))
    line = F.concat(F.col("turn").cast("double").cast("string"), F.lit(" --> "), (F.col("turn") + 1).cast("double").cast("string"), F.lit(" | <b>"), F.col("role"), F.lit("</b>"))
    lines = c.select("conv_id", F.struct("turn", line.alias("l")).alias("x"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))


def _instruments(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Acquisition", "bitcoin", "crypto fund", "ADR", "warrants"))), (k % 5 + 1).cast("int"))
    symbol = F.element_at(F.array(*map(F.lit, ("RIOT", "COIN", "XYZ"))), (k % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", kind).alias("name"), symbol.alias("symbol"), (k % 80 + 10).alias("code"))


QUERIES = {
    "a1_read_posts": entry(lambda s, d: posts.parse_posts(_lines(s, d)).agg(F.count("*").alias("n_read"), F.count("_bad").alias("n_bad"), F.countDistinct("id").alias("ids"), F.sum("score").alias("score")),
        "select count(*) as n_read, count(*) filter (doc_id % 17 = 0) as n_bad, count(*) filter (doc_id % 17 <> 0) as ids, cast(sum(n_chars) filter (doc_id % 17 <> 0) as bigint) as score from documents"),
    "a2_split_by_community": entry(lambda s, d: posts.split_by_community(_posts(s, d), ["SRC0", "Src3", "src5"]).groupBy("community").agg(F.count("*").alias("n")), "select source as community, count(*) as n from documents where source in ('src0', 'src3', 'src5') and doc_id % 17 <> 0 group by 1"),
    "a3_csv_strict": entry(lambda s, d: posts.parse_csv_strict(table(s, d, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 5 == 0, "NA").when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))).alias("value")), "k bigint, symbol string"),
        "select s_suppkey as k, case when s_suppkey % 5 = 0 then 'NA' when s_suppkey % 3 = 0 then null else s_name end as symbol from supplier"),
    "a4_listing_directory": entry(lambda s, d: posts.parse_listing(table(s, d, "part").select(F.concat_ws("|", F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "p_name", F.when(F.col("p_size") < 5, "Y").otherwise("N")).alias("value")).union(table(s, d, "region").select(F.concat(F.lit("File Creation Time: "), F.col("r_name")))), ["symbol", "name", "test_issue"]),
        "select 'P' || p_partkey as symbol, p_name as name, 'N' as test_issue from part where p_size >= 5"),
    "a5_keys_from_path": entry(lambda s, d: table(s, d, "pages").select("page_id", *posts.keys_from_path(F.col("url"), r"^https?://([a-z]+)\.example\.com/([a-z]{2})/", ["host", "lang"])), r"select page_id, regexp_extract(url, '^https?://([a-z]+)\.example\.com/([a-z]{2})/', 1) as host, regexp_extract(url, '^https?://([a-z]+)\.example\.com/([a-z]{2})/', 2) as lang from pages"),
    "a6_json_array": entry(lambda s, d: posts.parse_json_array(table(s, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "x").alias("error"))))).alias("value")), "struct<id:bigint,error:string>").select("id"), "select event_id as id from events where event_type <> 'error'"),
    "a7_unpivot": entry(lambda s, d: posts.unpivot_matrix(table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("day"), "l_quantity", "l_tax"), "day", ["l_quantity", "l_tax"]).groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("n").alias("n")), "select 'l_quantity' as symbol, count(*) as \"rows\", sum(l_quantity) as n from lineitem union all select 'l_tax', count(*), sum(l_tax) from lineitem", "n"),
    "a8_pivot_matrix": entry(lambda s, d: posts.pivot_matrix(v.hourly(s, d).withColumnRenamed("step", "day"), ["click", "error", "purchase", "signup", "view"]), with_views("h", "select step as day, cast(coalesce(sum(n) filter (symbol = 'click'), 0) as bigint) as click, cast(coalesce(sum(n) filter (symbol = 'error'), 0) as bigint) as error, cast(coalesce(sum(n) filter (symbol = 'purchase'), 0) as bigint) as purchase, cast(coalesce(sum(n) filter (symbol = 'signup'), 0) as bigint) as signup, cast(coalesce(sum(n) filter (symbol = 'view'), 0) as bigint) as view from h group by 1")),
    "a9_scan_facts": entry(lambda s, d: posts.scan_facts(table(s, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")), "l_shipdate", "1996-01-01", "1997-01-01", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity"), "select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= '1996-01-01' and l_shipdate < '1997-01-01' and l_returnflag = 'R'", "l_quantity"),
    "a12_inventory": entry(lambda s, d: posts.inventory(table(s, d, "events"), "event_type", "ts"), "select event_type, count(*) as records, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day from events group by 1"),
    "b1_tombstones": entry(lambda s, d: cleaning.drop_tombstones(_tomb(s, d), "text"), f"with {_TOMB} select * from t where text is not null and text not in ('[removed]', '[deleted]', '')"),
    "b2_utc_day": entry(lambda s, d: cleaning.with_utc_day(_posts(s, d).select("id", "created_utc"), "created_utc", "2024-01"), "select cast(doc_id as varchar) as id, cast(doc_id * 3600 + 1704067200 as varchar) as created_utc, date '2024-01-01' + cast(doc_id // 24 as integer) as day from documents where doc_id % 17 <> 0 and doc_id // 24 < 31"),
    "b3_message_text": entry(lambda s, d: table(s, d, "documents").select("doc_id", cleaning.message_text(F.when(F.col("doc_id") % 2 == 0, "post").otherwise("comment"), F.col("source"), F.when(F.col("doc_id") % 6 == 0, "[deleted]").otherwise(F.col("text"))).alias("text")), "select doc_id, substring(case when doc_id % 2 = 0 then source || chr(10) || case when doc_id % 6 = 0 then '' else text end else text end, 1, 800) as text from documents"),
    "b4_clean_html": entry(lambda s, d: table(s, d, "pages").select("page_id", cleaning.clean_html(F.col("html")).alias("text"))),
    "b4_strip_html": entry(lambda s, d: table(s, d, "pages").select("page_id", F.length(cleaning.strip_html(F.regexp_replace("html", r"[^\x00-\x7F]", "x"))).alias("chars")), r"select page_id, cast(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[^\x00-\x7F]', 'x', 'g'), '<script[^>]*>.*?</script>|<!--.*?-->', ' ', 'gsi'), '<style[^>]*>.*?</style>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as integer) as chars from pages"),
    "b5_normalize_name": entry(lambda s, d: table(s, d, "part").select("p_partkey", cleaning.normalize_name(F.concat(F.initcap("p_name"), F.lit(" Holdings, Inc."))).alias("name")), "select p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '')[1:2], ' ') as name from part"),
    "b6_symbols": entry(lambda s, d: table(s, d, "supplier").select("s_suppkey", cleaning.base_symbol(F.concat(F.lit("ab"), F.col("s_suppkey").cast("string"), F.lit(".pr-"))).alias("base"), cleaning.root_symbol(F.element_at(F.array(F.lit("ABCDW"), F.lit("ABCDE"), F.lit("ABCW")), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("root")), "select s_suppkey, 'AB' || s_suppkey as base, ['ABCD', 'ABCDE', 'ABCW'][s_suppkey % 3 + 1] as root from supplier"),
    "b7_valid_symbol": entry(lambda s, d: table(s, d, "part").select("p_partkey", cleaning.valid_symbol(F.upper(F.col("p_name"))).alias("ok")), "select p_partkey, regexp_full_match(upper(p_name), '[A-Z0-9.\\-]{1,10}') as ok from part"),
    "b8_equity_code": entry(lambda s, d: table(s, d, "part").filter(cleaning.equity_code(F.col("p_partkey") % 90 + 10)).select("p_partkey"), "select p_partkey from part where (p_partkey % 90 + 10) % 10 not in (4, 5) and (p_partkey % 90 + 10) // 10 % 10 not in (7, 2, 4)"),
    "b9_flags": entry(lambda s, d: _instruments(s, d).select("p_partkey", *cleaning.flag_instruments(F.col("name"), F.col("symbol"), F.col("code"))), rf"""with n as (select p_partkey, upper(p_name || ' ' || ['Acquisition', 'bitcoin', 'crypto fund', 'ADR', 'warrants'][p_partkey % 5 + 1]) as name, ['RIOT', 'COIN', 'XYZ'][p_partkey % 3 + 1] as symbol, p_partkey % 80 + 10 as code from part)
        select p_partkey, regexp_matches(name, '{cleaning.SPAC_NAME}') as is_spac, (symbol <> 'XYZ' or regexp_matches(name, '{cleaning.CRYPTO_NAME}')) and code // 10 <> 7 as is_crypto, regexp_matches(name, '{cleaning.ADR_NAME}') as is_adr, regexp_matches(name, '(?i){cleaning.NON_SHARE_NAME}') as is_non_share from n"""),
    "b10_parse_day": entry(lambda s, d: _dates(s, d).select("o_orderkey", cleaning.parse_day(F.col("s")).alias("day")), "select o_orderkey, case when o_orderkey % 4 <> 3 then cast(o_orderdate as date) end as day from orders"),
    "b10_iso_duration": entry(lambda s, d: table(s, d, "part").select("p_partkey", cleaning.parse_iso_duration(F.concat(F.lit("PT"), F.when(F.col("p_size") > 20, F.concat((F.col("p_size") % 3).cast("string"), F.lit("H"))).otherwise(""), F.col("p_size").cast("string"), F.lit("M7S"))).alias("seconds")), "select p_partkey, cast(case when p_size > 20 then p_size % 3 * 3600 else 0 end + p_size * 60 + 7 as bigint) as seconds from part"),
    "b11_clean_trends": entry(lambda s, d: table(s, d, "events").select("event_id", cleaning.clean_trend(F.when(F.col("value") < 1, "<1").when(F.col("value") > 90, "").otherwise(F.floor("value").cast("string"))).alias("n")), "select event_id, case when value < 1 then 0.5 when value > 90 then 0.0 else floor(value) end as n from events", "n"),
    "b12_subtitles": entry(lambda s, d: cleaning.flatten_subtitles(_subtitles(s, d), "conv_id", "text").drop("run"), """select conv_id, cast(min(turn) as double) as start, cast(max(turn) + 1 as double) as "end", role as words from (select conv_id, turn, role, sum(f) over (partition by conv_id order by turn) as g
        from (select *, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as f from conversations)) group by conv_id, g, role""", 'start "end"'),
    "b13_impute": entry(lambda s, d: cleaning.impute_sentiment(table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality", (F.col("toxic") * 1.0).alias("dd"), (F.col("toxic") * 2.0).alias("bb")), "doc_id", "left"), ["quality"], "dd", "bb"), "select doc_id, coalesce(quality, 0) as quality, cast(coalesce(toxic, 0.5) as double) as dd, cast(coalesce(toxic * 2, 0) as double) as bb, (toxic is null)::int as no_direction from documents left join labels using (doc_id)", "dd bb"),
    "b14_covariates": entry(lambda s, d: table(s, d, "supplier").select("s_suppkey", *cleaning.derive_covariates(F.col("s_acctbal"), F.col("s_acctbal") / 10, F.col("s_acctbal") / 1000, F.col("s_acctbal") / 5000)), "select s_suppkey, ln(1 + greatest(s_acctbal, 0)) as log_z, ln(1 + greatest(s_acctbal / 10, 0)) as log_base, ln(greatest(s_acctbal / 1000, 0.1)) as log_amplitude, ln(greatest(s_acctbal / 5000, 0.1)) as log_volume from supplier", "log_z log_base log_amplitude log_volume"),
    "b15_labels": entry(lambda s, d: table(s, d, "part").select("p_partkey", cleaning.label_coupling(F.when(F.col("p_size") < 45, F.col("p_size") - 20)).alias("coupling"), cleaning.label_phase(F.col("p_size"), F.lit(10), F.lit(30)).alias("phase")), "select p_partkey, case when p_size >= 45 then 'no_price' when abs(p_size - 20) < 2 then 'synchronous' when p_size < 20 then 'price_leads' else 'price_trails' end as coupling, case when p_size < 10 then 'pre' when p_size > 30 then 'post' else 'event' end as phase from part"),
    "b16_dedupe": entry(lambda s, d: cleaning.dedupe(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]), "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1", "o_totalprice"),
    "b17_exclude_overlap": entry(lambda s, d: cleaning.exclude_overlap(table(s, d, "documents").filter("doc_id % 2 = 0").select("doc_id", "text"), table(s, d, "documents").filter("doc_id % 2 = 1"), "text").select("doc_id"), "select doc_id from documents where doc_id % 2 = 0 and trim(text) not in (select trim(text) from documents where doc_id % 2 = 1)"),
    "b18_array_pick": entry(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f"), F.to_date("l_shipdate").alias("x"))).alias("a")).select("l_orderkey", cleaning.array_pick(F.col("a.f"), F.col("a.x"), "R").alias("earliest"), cleaning.array_pick(F.col("a.f"), F.col("a.x"), "A", False).alias("latest")), "select l_orderkey, min(cast(l_shipdate as date)) filter (l_returnflag = 'R') as earliest, max(cast(l_shipdate as date)) filter (l_returnflag = 'A') as latest from lineitem group by 1"),
    "a15_entities": entry(lambda s, d: joins.contains_join(table(s, d, "part").select("p_partkey", "p_name"), posts.entities(s, [("W", "widget"), ("R", "ring"), ("B", "bolt")]), "p_partkey", "p_name"), "select p_partkey, symbol from part, (values ('W', 'WIDGET'), ('R', 'RING'), ('B', 'BOLT')) as e(symbol, name) where contains(' ' || upper(p_name) || ' ', ' ' || name || ' ')"),
    "e12_latest_month": entry(lambda s, d: table(s, d, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).filter("r = 1").select("o_custkey", "o_orderkey"), "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1"),
    "b15_more_labels": entry(lambda s, d: table(s, d, "part").select("p_partkey", cleaning.label_life(F.col("p_size") < 10, F.when(F.col("p_size") > 30, F.col("p_name"))).alias("life"), cleaning.label_era(F.col("p_size") + 1995).alias("era"), cleaning.label_tier(F.col("p_size") / 50).alias("tier"),
        *cleaning.label_listing(F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit(25))), """select p_partkey, case when p_size < 10 then 'delisted' when p_size > 30 then 'renamed' else 'active' end as life, case when p_size <= 26 then '2020-2021 meme' when p_size <= 28 then '2022-2023' else '2024-2026' end as era,
        case when p_size >= 40 then 'high' when p_size >= 25 then 'middle' else 'low' end as tier, case when p_size % 3 = 0 or (p_size % 2 = 0 and p_size >= 25) then p_size end as listed,
        case when p_size % 3 = 0 and p_size >= 25 then 'registration' when p_size % 3 = 0 then 'review_old_registration' when p_size % 2 = 0 and p_size >= 25 then 'first_filing' else 'manual' end as listing_method from part"""),
    "a4_union_listings": entry(lambda s, d: posts.union_listings(table(s, d, "part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 300).cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.lit("NASDAQ").alias("exchange")), table(s, d, "supplier").select(F.concat(F.lit("P"), (F.col("s_suppkey") * 7).cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.lit("NYSE").alias("exchange"))),
        """with u as (select 'P' || (p_partkey % 300) as symbol, p_name as name, 'NASDAQ' as exchange, 0 as f from part union all select 'P' || (s_suppkey * 7), s_name, 'NYSE', 1 from supplier) select symbol, name, exchange from (select *, row_number() over (partition by symbol order by f, name) as r from u) where r = 1"""),
    "a6_first_per_id": entry(lambda s, d: posts.first_per_id(table(s, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", "event_type"), "id", ["ts", "event_id"]), "select user_id as id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1"),
}
