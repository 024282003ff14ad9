"""Canonical inputs of the registered queries, derived from the given tables, with the same derivations as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detector, joins

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, without negative zeros."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def entry(run: Query, sql: str | None = None, doubles: str = "") -> Entry:
    """A query whose doubles are rounded on both sides."""
    if sql and doubles:
        replaced = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in doubles.split())
        body = sql.strip()
        sql = f"select * replace ({replaced}) from ({body})"
    return Entry(lambda spark, d: rounded(run(spark, d)), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PARAMS = detector.Params(window=24, least=12, z_on=2.0, min_abs=5, kappa=0.25, k_off=3, gap=3, min_steps=2, min_total=10)


def hour(ts: str):
    """Hours since 1970-01-01 of a timestamp without time zone, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)).cast("long")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Event types as symbols, hours as steps."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), hour("ts").alias("step")).agg(F.count("*").alias("n"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return joins.densify(hourly(spark, d))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return detector.catalog(dense(spark, d), PARAMS)


def events(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("event_id", "symbol", "start", "peak", "end", "censored")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as labelled messages: the label and its probabilities follow from k in props."""
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.element_at(F.array(F.lit("bull"), F.lit("bear"), F.lit("neutral")), k % 3 + 1)
    return table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("symbol"), hour("ts").alias("step"), "user_id", "value", label.alias("label"), k.alias("k"),
        (k / 200).alias("p_bull"), ((100 - k) / 200).alias("p_bear"), F.lit(0.5).alias("p_neutral"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Supplier groups as symbols: daily mean unit price, quantity, return on the last priced day."""
    l = table(spark, d, "lineitem")
    per = l.groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("step")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("step"))
    return per.withColumn("ret", F.col("close") / before - 1)


def lives(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as validity intervals up to the day before the next one; the last is open."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("start")).agg(F.min("o_orderpriority").alias("state"))
    end = F.date_sub(F.lead("start").over(Window.partitionBy("o_custkey").orderBy("start")), 1)
    return o.select(F.col("o_custkey").alias("entity"), "start", end.alias("end"), "state")


#: Lines of orders that a task sums up and joins.
LINES = 1 << 20


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as durations of 1 to 60 steps: the distance to the first shipment, censored at 60.

    Orders and their lines are dealt into as many parts as the lines ask for, so that what a task holds doesn't grow with them.
    """
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    ship = lines.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.to_date("l_shipdate")).alias("s"), F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, d, "orders").repartition(parts, "o_orderkey").join(ship, "o_orderkey")
    gap = F.abs(F.datediff("s", F.to_date("o_orderdate"))) % 90 + 1
    return o.select(
        "o_orderkey", F.col("o_custkey").alias("cluster"), F.least(gap, F.lit(60)).alias("t"), (gap < 60).cast("int").alias("e"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year"),
        (F.col("o_totalprice") / 100000).alias("x1"), F.col("lines").cast("double").alias("x2"), (F.col("quantity") / 100).alias("x3"),
    )


#: The same as common table expressions.
SQL = {
    "h": "h as (select event_type as symbol, cast(floor(epoch_us(ts) / 3600000000) as bigint) as step, count(*) as n from events group by 1, 2)",
    "dense": """dense as (select s.symbol, g.step, coalesce(h.n, 0) as n from (select distinct symbol from h) s
        cross join (select unnest(range(lo, hi + 1)) as step from (select min(step) as lo, max(step) as hi from h)) g left join h on h.symbol = s.symbol and h.step = g.step)""",
    "based": """based as (select symbol, step, n, case when count(n) over w >= 12 then avg(n) over w end as mu, case when count(n) over w >= 12 then stddev_samp(n) over w end as sigma
        from dense where symbol in (select symbol from dense group by symbol having max(n) >= 5) window w as (partition by symbol order by step rows between 24 preceding and 1 preceding))""",
    "z": "z as (select *, case when mu is not null and sigma is not null then (n - mu) / greatest(sigma, sqrt(mu), 1.0) end as z from based)",
    "numbered": "numbered as (select *, row_number() over (partition by symbol order by step) as k from z)",
    "walk": """walk as (select distinct symbol, cast(0 as bigint) as k, cast(0 as bigint) as step, false as is_on, cast(0 as bigint) as s, 0.0::double as mu0, 0.0::double as sigma0, 0.0::double as z0, 0.0::double as peak, 0 as below, false as ended from numbered
        union all select symbol, k, step, case when begins then true when stops then false else is_on end, case when begins then step else s end, case when begins then mu else mu0 end, case when begins then greatest(sigma, sqrt(mu), 1.0) else sigma0 end,
            case when begins then z else z0 end, case when begins then n when is_on then top else peak end, case when begins or stops then 0 when is_on then low else below end, stops
        from (select *, is_on and low >= 3 as stops from (select r.*, w.is_on, w.s, w.mu0, w.sigma0, w.z0, w.peak, w.below, not w.is_on and coalesce(r.z >= 2.0, false) and r.n >= 5 as begins, greatest(w.peak, r.n) as top,
            case when r.n < greatest(w.mu0 + w.sigma0, 0.25 * greatest(w.peak, r.n)) then w.below + 1 else 0 end as low from walk w join numbered r on r.symbol = w.symbol and r.k = w.k + 1)))""",
    "found": """found as (select symbol, s as start, step - 3 as "end", false as censored, mu0, sigma0, z0 from walk where ended
        union all select w.symbol, w.s, w.step, true, w.mu0, w.sigma0, w.z0 from walk w join (select symbol, max(k) as k from walk group by symbol) m on m.symbol = w.symbol and m.k = w.k where w.is_on)""",
    "merged": """merged as (select symbol, min(start) as start, max("end") as "end", arg_max(censored, start) as censored, arg_min(mu0, start) as mu0, arg_min(sigma0, start) as sigma0, arg_min(z0, start) as z0, count(*) as n_merged
        from (select *, sum(fresh) over (partition by symbol order by start) as g from (select *, case when start - lag("end") over (partition by symbol order by start) <= 3 then 0 else 1 end as fresh from found)) group by symbol, g)""",
    "cat": """cat as (select m.symbol || '_' || m.start as event_id, m.symbol, m.start, p.peak, m."end", m."end" - m.start + 1 as duration, p.peak - m.start as to_peak, p.peak_n, p.total, m.mu0, m.sigma0, m.z0, m.censored,
            m."end" - m.start + 1 >= 2 and p.total >= 10 as principal, p.peak_n / greatest(m.mu0, 1.0) as amplitude, m."end" - m.start + 1 >= 60 and p.peak_n / greatest(m.mu0, 1.0) < 8 as slow, m.n_merged
        from merged m join (select m.symbol, m.start, arg_max(d.step, d.n * 1000000000 - d.step) as peak, max(d.n) as peak_n, sum(d.n) as total from merged m join dense d on d.symbol = m.symbol and d.step between m.start and m."end" group by 1, 2) p
        on p.symbol = m.symbol and p.start = m.start)""",
    "m": """m as (select event_id, event_type as symbol, cast(floor(epoch_us(ts) / 3600000000) as bigint) as step, user_id, value, ['bull', 'bear', 'neutral'][k % 3 + 1] as label, k, k / 200.0 as p_bull, (100 - k) / 200.0 as p_bear, 0.5 as p_neutral
        from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))""",
    "p": """p as (select *, close / lag(close) over (partition by symbol order by step) - 1 as ret from (select 'S' || (l_suppkey % 20) as symbol, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as step,
        sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1, 2))""",
    "lives": """lives as (select o_custkey as entity, start, lead(start) over (partition by o_custkey order by start) - 1 as "end", state from (select o_custkey, cast(o_orderdate as date) as start, min(o_orderpriority) as state from orders group by 1, 2))""",
    "dur": """dur as (select o.o_orderkey, o_custkey as "cluster", least(gap, 60) as t, cast(gap < 60 as integer) as e, o_orderpriority as grp, year(o_orderdate) as year, o_totalprice / 100000 as x1, cast(lines as double) as x2, quantity / 100 as x3
        from orders o join (select l.l_orderkey, min(cast(l_shipdate as date)) as s, count(*) as lines, sum(l_quantity) as quantity from lineitem l group by 1) l on l.l_orderkey = o.o_orderkey,
        lateral (select abs(date_diff('day', cast(o_orderdate as date), s)) % 90 + 1 as gap))""",
}
_NEEDS = {"dense": "h", "based": "dense", "z": "based", "numbered": "z", "walk": "numbered", "found": "walk", "merged": "found", "cat": "merged"}


def with_views(names: str, body: str) -> str:
    """SQL with the named views and those that they need in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return f"with {'recursive ' if 'walk' in order else ''}" + ", ".join(SQL[n] for n in order) + " " + body
