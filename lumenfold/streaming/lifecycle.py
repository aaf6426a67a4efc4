"""Jobs, subscriptions, edits and previews as streams: processors with event-time timers, and session windows.

All take what the watermark allows only: rows wait until it has passed them and are then taken in order, so that results don't depend on how a stream
is cut into batches. A row that comes in behind the watermark is late, and dropped. Nothing is kept of what has ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.streaming.jobs import EXPIRY_S, TIMEOUT_S

LONG, TEXT, INT = T.LongType(), T.StringType(), T.IntegerType()
#: Stands for null in a list of state: long lists go through pandas, where a null beside whole numbers makes floats of them.
NULL = -(2**31)


def _struct(**kinds: T.DataType) -> T.StructType:
    """A schema made without a session, as a processor's start has none."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


class InOrder(StatefulProcessor):
    """Rows of a key in order of (at, n), when the watermark has passed them.

    A subclass names the fields of its rows behind at and n, and of what it holds; take(held, row) and lapse(held, upto) yield result rows through
    self.put and give what is held from then on, or None. due(held) is when lapse has to be called (microseconds), if no row comes before.
    """

    row: dict[str, T.DataType] = {}
    held: dict[str, T.DataType] = {}
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _struct(at=LONG, n=LONG, **self.row))
        self.now = handle.getValueState("held", _struct(**self.held))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802
        new = [r for df in rows for r in zip(*(df[c].tolist() for c in ("at", "n", *self.row)), strict=True)]
        kinds = (LONG, LONG, *self.row.values())
        new = [tuple((None if k is TEXT else NULL) if x is None or x != x else x if k is TEXT else int(x) for x, k in zip(r, kinds, strict=True)) for r in new]
        if new and key[0] is not None and key[0] == key[0]:  # rows without a key, as the closing one, wait for nothing
            self.pending.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802
        import pandas as pd

        self.made: list[tuple] = []
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.pending.get()), key=lambda r: r[:2])
        held = tuple(self.now.get()) if self.now.exists() else None
        had = held
        ready = [r for r in waiting if r[0] <= upto]
        for r in ready:
            held = self.take(key[0], self._lapsed(key[0], held, r[0]), tuple(None if x == NULL else x for x in r))
        held = self._lapsed(key[0], held, upto + 1)
        later = waiting[len(ready) :]
        if ready:
            if later:
                self.pending.put(later)
            else:
                self.pending.clear()
        if held != had:
            if held is None:
                self.now.clear()
            else:
                self.now.update(held)
        wake = [r[0] for r in later[:1]] + ([self.due(held)] if held is not None else [])
        if wake:
            self._wake(min(wake))
        if self.made:
            yield pd.DataFrame([(key[0], *m) for m in self.made], columns=self.out)

    def _lapsed(self, key, held, at: int):
        """What is held just before a time: it lapses as soon as nothing at or before its due time can come."""
        while held is not None and self.due(held) < at:
            held = self.lapse(key, held)
        return held

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


RUNS = "job_id long, started long, ended long, status string, pct int, message string, n_events long"


class JobRuns(InOrder):
    """A job's runs: from its first event to done, error, idle for too long, or longer than a run may take."""

    row = {"event": TEXT, "pct": INT, "message": TEXT}
    held = {"started": LONG, "last": LONG, "pct": INT, "n": LONG}
    out = [x.split()[0] for x in RUNS.split(", ")]

    def __init__(self, idle_s: int, limit_s: int) -> None:
        self.idle, self.limit = idle_s * 1_000_000, limit_s * 1_000_000

    def due(self, held) -> int:
        return min(held[1] + self.idle, held[0] + self.limit)

    def lapse(self, key, held):
        over = held[0] + self.limit < held[1] + self.idle
        self.made.append((held[0], self.due(held), "error", held[2], "over the limit" if over else "timeout", held[3]))

    def take(self, key, held, row):
        at, _, event, pct, message = row
        started, _, share, n = held or (at, at, 0, 0)
        if event in ("done", "error"):
            self.made.append((started, at, event, 100 if event == "done" else share, message, n + 1))
            return None
        return started, at, share if pct is None else pct, n + 1


def job_runs(events: DataFrame, idle_s: int = TIMEOUT_S, limit_s: int = TIMEOUT_S, order: str = "event_id") -> DataFrame:
    """The runs of streamed jobs as they end: (job_id, started, ended, status, pct, message, n_events), times in microseconds.

    events: job_id, ts (with a watermark), event, pct, message and `order`, which decides among events of one time. A run that stays silent for longer than idle_s ends
    as an error at that moment, and one that lasts longer than limit_s at its limit: by a timer, without a next event. An event exactly at such a moment still counts.
    """
    rows = events.where("ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "ts", micros("ts").alias("at"), F.col(order).cast("long").alias("n"), "event", F.col("pct").cast("int").alias("pct"), "message")
    return rows.groupBy("job_id").transformWithStateInPandas(JobRuns(idle_s, limit_s), RUNS, "append", "eventTime")


DELIVERED = "job_id long, sub_id long, at long, event string, pct int"


class Deliveries(InOrder):
    """What each subscriber of a job gets. Rows are subscriptions and events; the job's terminal event or its open subscriptions are held."""

    row = {"kind": TEXT, "pct": INT, "sub_id": LONG, "until": LONG}
    held = {"event": TEXT, "pct": INT, "at": LONG, "subs": TEXT}  # subs: JSON of [until, sub_id], the first to end in front
    out = [x.split()[0] for x in DELIVERED.split(", ")]

    def __init__(self, keep_s: int) -> None:
        self.keep = keep_s * 1_000_000

    def due(self, held) -> int:
        return held[2] + self.keep if held[0] is not None else json.loads(held[3])[0][0]

    @staticmethod
    def _open(subs: list):
        return (None, None, None, json.dumps(sorted(subs))) if subs else None

    def lapse(self, key, held):
        subs = [] if held[0] is not None else json.loads(held[3])
        return self._open([s for s in subs if s[0] > subs[0][0]])

    def take(self, key, held, row):
        at, _, kind, pct, sub, until = row
        event, share, _, subs = held or (None, None, None, "[]")
        subs = json.loads(subs or "[]")
        if kind == "subscribe":
            if event is None:
                return self._open([*subs, [until, sub]])
            self.made.append((sub, at, event, share))
            return held
        # An event behind the end begins the job anew: nobody is subscribed to it then.
        self.made += [(s, at, kind, pct) for _, s in subs]
        return (kind, pct, at, None) if kind in ("done", "error") else self._open(subs)


def deliveries(events: DataFrame, subscriptions: DataFrame, keep_s: int, order: str = "event_id") -> DataFrame:
    """What subscribers get of streamed jobs: (job_id, sub_id, at, event, pct), at in microseconds.

    events: job_id, ts, event, pct, `order`. subscriptions: job_id, ts (when it begins), until, sub_id. A subscriber gets the events from its beginning to `until` or
    to the job's terminal event, not those before. One that comes after the job's end gets its terminal event at once, as long as that is kept (keep_s, or until the job begins anew). Of one time,
    events go before subscriptions.
    """
    none = lambda kind: F.lit(None).cast(kind)
    told = events.where("ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "ts", micros("ts").alias("at"), F.col(order).cast("long").alias("n"), F.col("event").alias("kind"), F.col("pct").cast("int").alias("pct"), none("long").alias("sub_id"), none("long").alias("until"))
    asked = subscriptions.where("ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "ts", micros("ts").alias("at"), (F.lit(2**62) + F.col("sub_id")).alias("n"), F.lit("subscribe").alias("kind"), none("int").alias("pct"), F.col("sub_id").cast("long").alias("sub_id"), micros("until").alias("until"))
    return told.unionByName(asked).groupBy("job_id").transformWithStateInPandas(Deliveries(keep_s), DELIVERED, "append", "eventTime")


def debounced_stream(events: DataFrame, millis: int = 300, order: str = "event_id") -> DataFrame:
    """The last event of each run of a job's events with gaps of less than millis, when the run is over: (job_id, ts, order, n_events).

    Events without a job are one job's. (They aren't filtered out here, as Spark would do so before it sees their times.)
    """
    # Sessions that touch are one, so that they are a microsecond shorter than the gap that parts them.
    run = events.groupBy("job_id", F.session_window("ts", f"{1000 * millis - 1} microseconds"))
    return run.agg(F.max(F.struct("ts", order)).alias("last"), F.count("*").alias("n_events")).select("job_id", "last.*", "n_events")


EXPIRED = "job_id long, created long, ended long, replaced boolean"


class Previews(InOrder):
    """A job's preview: the newest holds, until its time is over or another replaces it."""

    held = {"created": LONG}
    out = [x.split()[0] for x in EXPIRED.split(", ")]

    def __init__(self, seconds: int) -> None:
        self.keep = seconds * 1_000_000

    def due(self, held) -> int:
        return held[0] + self.keep

    def lapse(self, key, held):
        self.made.append((held[0], held[0] + self.keep, False))

    def take(self, key, held, row):
        if held is not None:
            self.made.append((held[0], row[0], True))
        return (row[0],)


def expiring_previews(created: DataFrame, seconds: int = EXPIRY_S, order: str = "event_id") -> DataFrame:
    """When each preview (job_id, ts with a watermark) ended and whether by a newer one: (job_id, created, ended, replaced), times in microseconds."""
    rows = created.where("ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "ts", micros("ts").alias("at"), F.col(order).cast("long").alias("n"))
    return rows.groupBy("job_id").transformWithStateInPandas(Previews(seconds), EXPIRED, "append", "eventTime")
