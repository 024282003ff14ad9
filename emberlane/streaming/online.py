"""Streams: incremental counts, the online detector, running indices of open events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detector import Automaton, Params, online_z


def count_stream(events: DataFrame, time: str, symbol: str, late: str = "2 days", unit: str = "1 day") -> DataFrame:
    """Counts per unit and symbol; rows later than the watermark are dropped by the engine and reported in its progress."""
    return events.withWatermark(time, late).groupBy(F.window(time, unit).alias("w"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "symbol", "n")


def ingest(events: DataFrame, time: str, symbol: str, sink: str, checkpoint: str, late: str = "2 days", unit: str = "1 day"):
    """Everything that has arrived, once per file, into Parquet; started again it goes on where it stopped."""
    return (
        count_stream(events, time, symbol, late, unit)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_batches(rows: DataFrame, keys: list[str], sink: str, checkpoint: str) -> None:
    """Every new file counted once; a batch's counts go to a folder of its own, so a repeated batch replaces itself.

    The sink holds counts per batch; their sum by key is the total whatever the order in which files arrive.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_logged(rows: DataFrame, time: str, keys: list[str], sink: str, checkpoint: str, late: str = "2 days") -> None:
    """Counts by file, key and lateness, once per file, with nothing dropped unseen.

    A row is late if its time lies more than ``late`` before the latest time of all earlier batches; rows without a time are
    malformed. Both are counted apart. A batch's rows go to its own folder (a repeated batch replaces itself) and its horizon
    comes from the folders of the batches before it, so a batch that is run again gives the same rows. Read the totals with
    ``kept_counts`` and the log of files with ``file_log``. ``rows`` is a file stream.
    """
    stream = rows.select("*", F.col("_metadata.file_path").alias("_file"))

    def write(batch: DataFrame, number: int) -> None:
        spark, horizon = batch.sparkSession, F.lit(None).cast("timestamp")
        if number:
            before = _logged(spark, sink, F.col("batch") < number).agg(F.max("max_time")).first()[0]
            if before is not None:
                horizon = F.lit(before) - F.expr(f"interval {late}")
        state = F.when(F.col(time).isNull(), "malformed").when(F.col(time) < horizon, "late").otherwise("kept")
        found = batch.groupBy(F.col("_file").alias("file"), state.alias("state"), *keys).agg(F.count("*").alias("n"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _logged(spark, sink: str, which=None) -> DataFrame:
    found = spark.read.option("mergeSchema", True).parquet(sink)
    return found if which is None else found.filter(which)


def kept_counts(spark, sink: str, keys: list[str]) -> DataFrame:
    """Totals by key of the rows that were not late, over all batches of ``ingest_logged``."""
    return _logged(spark, sink, F.col("state") == "kept").groupBy(*keys).agg(F.sum("n").alias("n"))


def file_log(spark, sink: str) -> DataFrame:
    """Per file: its batch, rows read, kept, late and malformed, and its first and last time."""
    n = lambda v: F.sum(F.when(F.col("state") == v, F.col("n")).otherwise(0)).alias(v)
    return _logged(spark, sink).groupBy("batch", "file").agg(F.sum("n").alias("read"), n("kept"), n("late"), n("malformed"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"))


_STATE = "on boolean, start long, mu double, sigma double, z double, peak double, below int, last long, total double, reached long, known long, told boolean, buffer array<double>"
_OUT = "symbol string, step long, kind string, start long, end long, value double"


def online_detector(counts: DataFrame, p: Params) -> DataFrame:
    """(symbol, step, n) in step order per symbol to notices: ignition, eligibility, and end with its confirmation step.

    Eligibility is E14's: the notice's ``end`` is the step by which the event is known to last and has its total, told at
    the first step at or over the threshold from then on, as a stay below it may turn out to be the confirmation of an end.
    The state of a symbol is the automaton's and the last ``window`` counts; a step that is not after the last one is ignored.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *machine_state, total, reached, known, told, buffer = state.get
            machine, buffer = Automaton(p, tuple(machine_state)), list(buffer)
        else:
            machine, total, reached, known, told, buffer = Automaton(p), 0.0, -1, -1, False, []
        rows = pd.concat(list(parts)).sort_values("step")
        notices = []
        for step, n in zip(rows["step"].tolist(), rows["n"].tolist()):
            if buffer and step <= machine.last:
                continue
            was_on = machine.on
            ended = machine.feed(step, n, *online_z(buffer, n, p))
            buffer = (buffer + [float(n)])[-p.window :]
            if machine.on and not was_on:
                total, reached, known, told = 0.0, -1, -1, False
                notices.append((key[0], step, "ignition", step, None, machine.z))
            if machine.on:
                total += n
                if reached < 0 and total >= p.min_total:
                    reached = step
                if machine.below == 0 and known < 0 and step - machine.start + 1 >= p.min_steps:
                    known = step
                if machine.below == 0 and not told and min(reached, known) >= 0:
                    told = True
                    notices.append((key[0], step, "eligible", machine.start, max(reached, known), total))
            if ended:
                notices.append((key[0], step, "end", ended[0], ended[1], ended[5]))
        state.update((*machine.state, total, reached, known, told, buffer))
        yield pd.DataFrame(notices, columns=["symbol", "step", "kind", "start", "end", "value"]).astype({"start": "Int64", "end": "Int64", "value": "float64"})

    return counts.groupBy("symbol").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_PANEL_STATE = "done long, bull long, bear long, total long, steps array<long>, bulls array<long>, bears array<long>, counts array<long>"
_PANEL = "event_id string, step long, b_lag double, d_lag double, silent_lag int, n_lag long, b_run double, d_run double, n_run long"


def _indices(bull: int, bear: int) -> tuple[float, float | None]:
    return math.log((1 + bull) / (1 + bear)), 1 - abs(bull - bear) / (bull + bear) if bull + bear else None


def running_panel(messages: DataFrame, events: DataFrame, time: str, unit_seconds: int, late: str) -> DataFrame:
    """For every step of an open event, as soon as the step before it is over: that step's optimism, disagreement (0.5
    with a dummy where nobody took a side) and messages, and the same running from the event's start to that step.

    ``messages``: stream of (symbol, step, label, ``time``), ``step`` counting units of ``unit_seconds`` since 1970;
    ``events``: static (event_id, symbol, start, end). An event's state holds the running counts and those of steps that the
    watermark has not closed; an event-time timer wakes it for steps without messages. A message of a closed step is ignored.
    An event is known from its first message on, at the latest at its start.
    """
    unit = unit_seconds * 1000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end = int(key[1]), int(key[2])
        if state.exists:
            done, bull, bear, total, steps, bulls, bears, counts = state.get
            open_ = {s: [c, v, n] for s, c, v, n in zip(steps, bulls, bears, counts)}
        else:
            done, bull, bear, total, open_ = start - 2, 0, 0, 0, {}
        for part in parts:
            for step, label, n in part.groupby(["step", "label"], dropna=False).size().reset_index(name="n").itertuples(index=False):
                if step > done:
                    mine = open_.setdefault(int(step), [0, 0, 0])
                    mine[0] += n if label == "bull" else 0
                    mine[1] += n if label == "bear" else 0
                    mine[2] += n
        rows, now = [], state.getCurrentWatermarkMs()
        while done < end - 1 and (done + 2) * unit <= now:
            done += 1
            c, v, n = open_.pop(done, (0, 0, 0))
            if done >= start:
                bull, bear, total = bull + c, bear + v, total + n
            (b, d), (b_run, d_run) = _indices(c, v), _indices(bull, bear)
            rows.append((key[0], done + 1, b, 0.5 if d is None else d, int(d is None), n, b_run, d_run, total))
        if (end + 1) * unit <= now:
            # the engine drops what is older than the watermark, so nothing begins the event again
            state.remove()
        else:
            kept = sorted(open_)
            state.update((int(done), int(bull), int(bear), int(total), kept, *([int(open_[s][k]) for s in kept] for k in range(3))))
            state.setTimeoutTimestamp(max(now + 1, (done + 2) * unit))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PANEL.split(", ")]).astype({"b_lag": "float64", "d_lag": "float64", "b_run": "float64", "d_run": "float64"})

    inside = messages.withWatermark(time, late).join(events.select("event_id", "symbol", "start", "end"), "symbol").filter(F.col("step").between(F.col("start") - 1, F.col("end")))
    return inside.groupBy("event_id", "start", "end").applyInPandasWithState(run, _PANEL, _PANEL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
