"""Streams that are replayed in pieces give the batch's rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberlane.sources.store import scratch
from emberlane.streaming import online

T0 = 470000


def moment(step, minute=30):
    return dt.datetime(1970, 1, 1) + dt.timedelta(hours=step, minutes=minute)


def replay(spark, rows, schema, query_of, files):
    """Rows delivered as files in turn; the rows that the stream puts out."""
    path, sink, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    for part in files:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
        stream = query_of(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(sink)).start().awaitTermination()
    return spark.read.parquet(sink).collect()


def test_running_panel_is_the_batch_panel(spark):
    rng = random.Random(4)
    events = [("a1", "A", T0 + 5, T0 + 12), ("a2", "A", T0 + 20, T0 + 20), ("b1", "B", T0 + 3, T0 + 9), ("none", "C", T0, T0 + 3)]
    rows = []
    for symbol in "AB":
        for step in range(T0, T0 + 25):
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                rows.append((symbol, step, rng.choice(["bull", "bear", "neutral", None]), moment(step, rng.randint(0, 59))))
    rows += [("A", T0 + 5, "bull", moment(T0 + 5)), ("A", T0 + 20, "bull", moment(T0 + 20)), ("B", T0 + 3, "bear", moment(T0 + 3))]
    # shuffled by up to four hours, in five deliveries; the last row moves the watermark on
    rows.sort(key=lambda r: (r[1] + rng.uniform(0, 4)))
    rows.append(("A", T0 + 900, None, moment(T0 + 900)))
    cuts = [0, len(rows) // 4, len(rows) // 3, len(rows) // 2, len(rows) - 1, len(rows)]
    static = spark.createDataFrame(events, "event_id string, symbol string, start long, end long")
    got = replay(spark, rows, "symbol string, step long, label string, time timestamp", lambda s: online.running_panel(s, static, "time", 3600, "8 hours"), [range(lo, hi) for lo, hi in zip(cuts, cuts[1:])])
    want = {}
    for e, symbol, start, end in events[:3]:
        for step in range(start, end + 1):
            n = lambda lo, hi, v=0: sum(1 for r in rows if r[0] == symbol and lo <= r[1] <= hi and (v == 0 or r[2] == v))
            c, v, cr, vr = n(step - 1, step - 1, "bull"), n(step - 1, step - 1, "bear"), n(start, step - 1, "bull"), n(start, step - 1, "bear")
            d = lambda x, y: 1 - abs(x - y) / (x + y) if x + y else None
            want[e, step] = (math.log((1 + c) / (1 + v)), 0.5 if d(c, v) is None else d(c, v), int(d(c, v) is None), n(step - 1, step - 1), math.log((1 + cr) / (1 + vr)), d(cr, vr), n(start, step - 1))
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[2:] == pytest.approx(want[r.event_id, r.step], nan_ok=True), (r.event_id, r.step)


def test_late_rows_are_counted_and_a_repeated_batch_replaces_itself(spark):
    path, sink, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    schema = "symbol string, time timestamp"
    deliveries = [[("A", 10), ("A", 30), ("B", None)], [("A", 29), ("A", 5), ("B", 4), ("B", 40)], [("A", 20), ("B", 39)]]
    for rows in deliveries:
        spark.createDataFrame([(s, None if h is None else moment(T0 + h)) for s, h in rows], schema).coalesce(1).write.mode("append").parquet(path)
        online.ingest_logged(spark.readStream.schema(schema).parquet(path), "time", ["symbol"], sink, state, "12 hours")
    log = {r.batch: (r.read, r.kept, r.late, r.malformed) for r in online.file_log(spark, sink).collect()}
    assert log == {0: (3, 2, 0, 1), 1: (4, 2, 2, 0), 2: (2, 1, 1, 0)}
    assert {r.symbol: r.n for r in online.kept_counts(spark, sink, ["symbol"]).collect()} == {"A": 3, "B": 2}
    # nothing new: nothing counted again
    online.ingest_logged(spark.readStream.schema(schema).parquet(path), "time", ["symbol"], sink, state, "12 hours")
    assert {r.symbol: r.n for r in online.kept_counts(spark, sink, ["symbol"]).collect()} == {"A": 3, "B": 2}
