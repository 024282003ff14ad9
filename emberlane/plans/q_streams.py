"""Queries of streams and file sinks: inputs are the given tables, read as file streams; results go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..operators import detector
from ..sources import posts
from ..sources.store import scratch, stored
from ..streaming import online
from . import q_panel
from . import views as v
from .views import PARAMS, entry, table, with_views


def _landed(spark, df, name: str, files: int):
    """A table landed as several files, as an ingest directory would hold them."""
    path = scratch(spark, name)
    df.repartition(files).write.parquet(path)
    return path


def _ingest(spark, d):
    """Half of the files, then the rest: the second run goes on where the first one stopped."""
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("symbol"))
    path, sink, state = scratch(spark, "land"), scratch(spark, "sink"), scratch(spark, "state")
    for part in (F.dayofmonth("day") <= 15, F.dayofmonth("day") > 15):
        events.filter(part).repartition(3).write.mode("append").parquet(path)
        online.ingest_batches(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path), ["day", "symbol"], sink, state)
    return spark.read.parquet(sink).groupBy("day", "symbol").agg(F.sum("n").alias("n"))


def _watermarked(spark, d):
    """Daily counts in append mode over files in time order: the days that the watermark has closed."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"))
    path, sink, state = scratch(spark, "land"), scratch(spark, "sink"), scratch(spark, "state")
    for part in (F.dayofmonth("ts") <= 15, F.dayofmonth("ts") > 15):
        events.filter(part).repartitionByRange(4, "ts").write.mode("append").parquet(path)
        online.ingest(spark.readStream.schema(events.schema).parquet(path), "ts", "symbol", sink, state).awaitTermination()
    out = spark.read.schema("period timestamp, symbol string, n long").parquet(sink)
    return out.select(F.to_date("period").alias("day"), "symbol", "n")


def _late(spark, d, result):
    """Two deliveries: the days from the 11th on, then those before it, of which all over 20 days before the last time are late."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"))
    sink, state = scratch(spark, "sink"), scratch(spark, "state")
    path = scratch(spark, "land")
    for k, part in enumerate((F.dayofmonth("ts") >= 11, F.dayofmonth("ts") < 11)):
        delivery = events.filter(part).withColumn("ts", F.when(F.col("symbol") != "error", F.col("ts")))
        delivery.coalesce(1).write.mode("append").parquet(path)  # a delivery of one file
        online.ingest_logged(spark.readStream.schema(events.schema).parquet(path), "ts", ["symbol", "day"], sink, state, "20 days")
    return result(spark, sink)


def _collect(spark, query_of):
    sink, state = scratch(spark, "sink"), scratch(spark, "state")
    found: list[str] = []

    def write(batch, number):
        path = f"{sink}/{number}"
        batch.write.mode("overwrite").parquet(path)
        found.append(path)

    query_of().writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(*found)


def _online(spark, d):
    path = scratch(spark, "dense")
    v.dense(spark, d).repartition(4, "symbol").write.parquet(path)
    return _collect(spark, lambda: online.online_detector(spark.readStream.schema("symbol string, step long, n long").parquet(path), PARAMS))


def _online_events(spark, d):
    """The detected events as the stream reports them; those still open are not ended yet."""
    return _online(spark, d).filter("kind = 'end'").select("symbol", "start", "end", F.col("step").alias("confirmed"))


def _online_eligible(spark, d):
    """The steps of eligibility as the stream reports them."""
    return _online(spark, d).filter("kind = 'eligible'").select("symbol", "start", F.col("end").alias("eligible"))


def _panel(spark, d):
    """Messages by the day they came, read day by day; a last delivery far ahead moves the watermark past the end."""
    at = lambda step: F.timestamp_seconds(step * 3600)
    messages = v.messages(spark, d).select("symbol", "step", "label", (at(F.col("step")) + F.expr("interval 30 minutes")).alias("time"))
    path = scratch(spark, "messages")
    messages.repartitionByRange(5, "time").write.parquet(path)
    messages.groupBy("symbol").agg((F.max("step") + 1000).alias("step"), F.lit(None).cast("string").alias("label"), (F.max("time") + F.expr("interval 1000 hours")).alias("time")).coalesce(1).write.mode("append").parquet(path)
    events = stored(v.events(spark, d).select("event_id", "symbol", "start", "end"), "events")
    stream = spark.readStream.schema("symbol string, step long, label string, time timestamp").option("maxFilesPerTrigger", 2).parquet(path)
    return _collect(spark, lambda: online.running_panel(stream, events, "time", 3600, "1000 hours"))


def _snapshot(spark, d):
    path = scratch(spark, "snapshots")
    for date, low in (("2024-01-01", 0), ("2024-02-01", 50), ("2024-01-01", 100)):
        posts.write_snapshot(table(spark, d, "customer").filter(F.col("c_custkey") >= low), path, date)
    return spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count("*").alias("n"))


def _csv(spark, d):
    path = scratch(spark, "csv")
    posts.write_table(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return posts.read_csv_strict(spark, path, "s_suppkey bigint, s_name string")


def _fan_out(spark, d):
    path = scratch(spark, "communities")
    posts.write_by(posts.split_by_community(table(spark, d, "documents").select(F.col("source").alias("subreddit"), "doc_id", "lang"), ["src1", "src2"]), path, "community", "lang")
    return spark.read.parquet(path).select("doc_id", "community", "lang")


def _windowed(spark, d):
    """One folder of files per symbol and day, the first three days without the value, and one without rows."""
    events = table(spark, d, "events").select("event_id", "value", F.to_date("ts").alias("day"), F.concat_ws("_", "event_type", F.to_date("ts").cast("string")).alias("window"))
    path = scratch(spark, "windows")
    events.filter(F.dayofmonth("day") > 3).drop("day").write.partitionBy("window").parquet(path)
    events.filter(F.dayofmonth("day") <= 3).drop("day", "value").write.mode("append").partitionBy("window").parquet(path)
    events.limit(0).select("event_id").write.parquet(f"{path}/window=quiet_2024-02-30")
    found = posts.read_windowed(spark, path, "window=([a-z]+)_([0-9-]+)", ["symbol", "day"])
    return found.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


QUERIES = {
    "a2_fan_out": entry(_fan_out, "select doc_id, source as community, lang from documents where source in ('src1', 'src2')"),
    "a10_materialize": entry(lambda s, d: posts.materialize(table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_quantity"), scratch(s, "facts")).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")), "select l_suppkey, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1", "q"),
    "a11_incremental": entry(_ingest, "select cast(ts as date) as day, event_type as symbol, count(*) as n from events group by 1, 2"),
    "n1_watermarked": entry(_watermarked, "select cast(ts as date) as day, event_type as symbol, count(*) as n from events where cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 2 days group by 1, 2"),
    "n1_late_rows": entry(lambda s, d: _late(s, d, lambda spark, sink: online.kept_counts(spark, sink, ["symbol", "day"])), """with h as (select max(ts) - interval 20 days as h from events where day(ts) >= 11 and event_type <> 'error')
        select event_type as symbol, cast(ts as date) as day, count(*) as n from events, h where event_type <> 'error' and (day(ts) >= 11 or ts >= h) group by 1, 2"""),
    "a11_file_log": entry(lambda s, d: _late(s, d, lambda spark, sink: online.file_log(spark, sink).select("batch", "read", "kept", "late", "malformed", F.to_date("min_time").alias("first"), F.to_date("max_time").alias("last"))), """with h as (select max(ts) - interval 20 days as h from events where day(ts) >= 11 and event_type <> 'error'),
        e as (select case when day(ts) >= 11 then 0 else 1 end as batch, ts, event_type = 'error' as bad, day(ts) < 11 and ts < h as is_late from events, h) select batch::int as batch, count(*) as read, count(*) filter (not bad and not is_late) as kept, count(*) filter (not bad and is_late) as late,
        count(*) filter (bad) as malformed, cast(min(ts) filter (not bad) as date) as first, cast(max(ts) filter (not bad) as date) as last from e group by 1"""),
    "a13_snapshot": entry(_snapshot, "select '2024-01-01' as snapshot_date, count(*) as n from customer where c_custkey >= 100 union all select '2024-02-01', count(*) from customer where c_custkey >= 50"),
    "a14_csv_sink": entry(_csv, "select s_suppkey, s_name from supplier"),
    "n1_count_stream": entry(lambda s, d: _collect_counts(s, d), "select cast(date_trunc('day', ts) as date) as day, event_type as symbol, count(*) as n from events group by 1, 2"),
    "n2_online_detector": entry(_online_events, with_views("found", 'select symbol, start, "end", "end" + 3 as confirmed from found where not censored')),
    "n2_online_eligible": entry(_online_eligible, with_views("found", """, st as (select f.symbol, f.start, f.mu0, f.sigma0, d.step, d.n, max(d.n) over w as pk, sum(d.n) over w as cum
        from found f join dense d on d.symbol = f.symbol and d.step between f.start and f."end" window w as (partition by f.symbol, f.start order by d.step)),
        k as (select symbol, start, min(case when cum >= 10 then step end) as a, min(case when ok and step - start + 1 >= 2 then step end) as b, max(case when ok then step end) as c
        from (select *, n >= greatest(mu0 + sigma0, 0.25 * pk) as ok from st) group by 1, 2) select symbol, start, greatest(a, b) as eligible from k where a is not null and b is not null and c >= greatest(a, b)""")),
    "n2_online_notices": entry(lambda s, d: _online(s, d).groupBy("symbol", "kind").agg(F.count("*").alias("n"))),
    "n3_running_panel": entry(_panel, q_panel._cat_m(q_panel._PANEL + """, r as (select *, sum(case when phase = 'event' then m_bull else 0 end) over w as c, sum(case when phase = 'event' then m_bear else 0 end) over w as v, sum(case when phase = 'event' then n else 0 end) over w as k
        from pn window w as (partition by event_id order by step)) select event_id, step + 1 as step, b as b_lag, coalesce(d, 0.5) as d_lag, cast(d is null as integer) as silent_lag, cast(n as bigint) as n_lag, ln((1 + c) / (1 + v)) as b_run,
        case when c + v > 0 then 1 - abs(c - v) / (c + v) end as d_run, cast(k as bigint) as n_run from r where step between start - 1 and "end" - 1"""), "b_lag d_lag b_run d_run"),
    "u1_detect_in_sql": entry(lambda s, d: _sql_events(s, d), with_views("found", "select * from found"), "mu0 sigma0 z0"),
    "u2_index_in_sql": entry(lambda s, d: _sql_index(s, d), with_views("m", """select symbol, ln((1 + c) / (1 + v)) as b, case when c + v > 0 then 1 - abs(c - v) / (c + v) end as d from (select symbol, count(*) filter (label = 'bull') as c, count(*) filter (label = 'bear') as v from m group by 1)"""), "b d"),
    "u3_stance_in_sql": entry(lambda s, d: _sql_stance(s, d)),
    "f1_three_machines": entry(lambda s, d: _agree(s, d), with_views("found", "select cast(3 as bigint) as machines, count(*) as events from found where not censored")),
    "h2_online_volume": entry(lambda s, d: q_panel.panel_of(s, d).groupBy("phase").agg(F.sum("n").alias("n")), q_panel._cat_m(q_panel._PANEL + " select phase, cast(sum(n) as bigint) as n from pn group by 1")),
    "a5_read_windowed": entry(_windowed, "select event_type as symbol, cast(cast(ts as date) as varchar) as day, count(*) as n, sum(case when day(ts) > 3 then value end) as value from events group by 1, 2", "value"),
}


def _sql_events(spark, d):
    sql.register(spark, PARAMS)
    z = detector.scored(v.dense(spark, d), PARAMS)
    return spark.sql("select * from detect_events(table(select symbol, step, n, mu, sigma, z from {z}) partition by symbol order by step)", z=z)


def _sql_index(spark, d):
    sql.register(spark, PARAMS)
    return spark.sql("select symbol, optimism(c, v) as b, disagreement(c, v) as d from (select symbol, count_if(label = 'bull') as c, count_if(label = 'bear') as v from {m} group by symbol)", m=v.messages(spark, d))


def _sql_stance(spark, d):
    sql.register(spark, PARAMS)
    return spark.sql("select stance_label(text) as label, count(*) as n from {c} group by 1", c=table(spark, d, "conversations"))


def _collect_counts(spark, d):
    """Daily counts by a stream in complete mode over the whole table."""
    events = table(spark, d, "events").select("ts", "event_type")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(_landed(spark, events, "land", 4))
    sink, state = scratch(spark, "sink"), scratch(spark, "state")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(sink)

    counts = stream.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(sink)


def _agree(spark, d):
    """Events found by the fold, by pandas groups and by the stream, and how many all three share."""
    z = detector.scored(v.dense(spark, d), PARAMS)
    keys = ["symbol", "start", "end"]
    parts = [df.select(*keys, F.lit(name).alias("by")) for name, df in (("fold", detector.detect(z, PARAMS).filter("not censored")), ("pandas", detector.detect_in_pandas(z, PARAMS).filter("not censored")), ("stream", _online_events(spark, d)))]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.count("*").alias("machines"))
    return seen.groupBy("machines").agg(F.count("*").alias("events"))
