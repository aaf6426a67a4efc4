"""Jobs from their events, in batch and as a stream.

Events: job_id, ts, event (step, done, error), step, pct, message.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_S = 300
EXPIRY_S = 600
# The phases that emit a step, each with its progress when it is done.
PHASES = {"Extraindo PDF": 20, "Matching de campos": 60, "Gerando template": 85, "Gerando HTML": 30, "Calculando fidelidade": 70}


def progress(step: Column) -> Column:
    """The share that is done after a phase; null for others."""
    out = F.lit(None).cast("int")
    for name, share in PHASES.items():
        out = F.when(step == name, share).otherwise(out)
    return out


def latest_state(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(job_id, event, step, pct, message, status) of each job's last event; done forces 100 %."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("ts", "event", "step", "pct", "message"), F.struct(*(order or ["ts"]))).alias("e")).select("job_id", "e.*")
    status = F.when(F.col("event") == "done", "done").when(F.col("event") == "error", "error").otherwise("running")
    return last.withColumns({"pct": F.when(F.col("event") == "done", 100).otherwise(F.col("pct")), "status": status})


def with_timeouts(events: DataFrame, seconds: int = TIMEOUT_S, order: list[str] | None = None) -> DataFrame:
    """events with the gap to the job's event before, and whether it is over the idle time. order: what else sets apart events of one time."""
    before = F.lag("ts").over(Window.partitionBy("job_id").orderBy(*(order or ["ts"])))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return events.withColumn("gap_s", gap).withColumn("timed_out", F.coalesce(F.col("gap_s") > seconds, F.lit(False)))


def durations(events: DataFrame, seconds: int = TIMEOUT_S) -> DataFrame:
    """(job_id, seconds, over): from each job's first to its last event."""
    took = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return events.groupBy("job_id").agg(took.alias("seconds")).withColumn("over", F.col("seconds") > seconds)


def debounced(events: DataFrame, millis: int = 300, order: list[str] | None = None) -> DataFrame:
    """The last event of each run of a job's events with gaps of less than millis. order: as in with_timeouts."""
    after = F.lead("ts").over(Window.partitionBy("job_id").orderBy(*(order or ["ts"])))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e3
    return events.withColumn("_lf_gap", gap).where(F.col("_lf_gap").isNull() | (F.col("_lf_gap") >= millis)).drop("_lf_gap")


def expired(created: str, now: str, seconds: int = EXPIRY_S):
    """Whether a preview of the column created is over its time at the column now."""
    return F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp")) > seconds * 1_000_000


STATE = "status string, pct int, last_ts long"
OUTPUT = "job_id string, status string, pct int, message string"


def _to_first_end(at, ids, event, pct, message):
    """The columns by time, then number, up to the first event that ends a job."""
    order = np.lexsort((ids, at))
    ends = np.flatnonzero(((event == "done") | (event == "error"))[order])
    order = order[: ends[0] + 1] if len(ends) else order
    return [c[order] for c in (at, ids, event, pct, message)]


def _in_order(batches):
    """(microseconds, event, pct, message) of a job by ts, then event_id if there is one. Arrow may cut a job's events into several frames, whose order tells nothing; of each, what lies behind an end isn't held."""
    held = []
    for batch in batches:
        ids = batch["event_id"].to_numpy() if "event_id" in batch else np.zeros(len(batch))
        held.append(_to_first_end(batch["ts"].to_numpy("datetime64[us]"), ids, *(batch[c].to_numpy() for c in ("event", "pct", "message"))))
    if held:
        at, _, *rest = held[0] if len(held) == 1 else _to_first_end(*(np.concatenate(c) for c in zip(*held)))
        yield from zip(at.astype("int64"), *rest)


def _advance(event_time: bool):
    def advance(key, batches, state):
        """A job's state after its new events; a terminal state stays; idle too long is an error."""
        import pandas as pd

        status, pct, last = state.get if state.exists else ("pending", 0, 0)
        if state.hasTimedOut:
            state.remove()
            if status not in ("done", "error"):
                yield pd.DataFrame({"job_id": [key[0]], "status": ["error"], "pct": [pct], "message": ["timeout"]})
            return
        message = None
        for now, event, share, text in _in_order(batches):
            if status in ("done", "error"):
                break
            now = int(now)
            if event_time and last and now - last > TIMEOUT_S * 1_000_000:
                status, message = "error", "timeout"
                break
            last = max(last, now)
            if event == "done":
                status, pct = "done", 100
            elif event == "error":
                status, message = "error", text
            else:
                status, pct = "running", int(share) if share == share and share is not None else pct
        state.update((status, pct, last))
        if not event_time:
            state.setTimeoutDuration(TIMEOUT_S * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "pct": [pct], "message": [message]})

    return advance


def stream_states(events: DataFrame, event_time: bool = False) -> DataFrame:
    """A streaming DataFrame of state changes, with state per job.

    A job without events for the idle time ends in error: by the clock, or with event_time where the event that comes next is later than that, which a
    replay decides as the live stream did. A batch's events go by ts, then event_id if there is one. A job that has ended keeps its state, as its end is to stay; where jobs
    come and go without end, lifecycle.job_runs ends them by timers and keeps nothing.
    """
    wait = "NoTimeout" if event_time else "ProcessingTimeTimeout"
    return events.groupBy("job_id").applyInPandasWithState(_advance(event_time), OUTPUT, STATE, "update", wait)


def fan_out(states: DataFrame, sinks: list, checkpoint: str, once: bool = True):
    """Starts a query that gives each micro-batch to all sinks, functions of (DataFrame, batch number).

    once: end after what is there now. Batches without data, in which alone idle jobs time out, run only without it.
    """

    def each(df: DataFrame, epoch: int) -> None:
        held = df.persist()
        for sink in sinks:
            sink(held, epoch)
        held.unpersist()

    writer = states.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    conf, key = states.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # a query takes its settings as it starts
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
