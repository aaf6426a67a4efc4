"""Jobs, subscribers, edits and previews by streams with event time. A user's events are a job's; their runs end by events or by timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.plans.job_queries import _EVENTS, events_of
from lumenfold.plans.registry import query, table
from lumenfold.streaming import lifecycle as L
from lumenfold.streaming.replay import Replay, replay

IDLE_S, LIMIT_S, DAY_S = 6 * 3600, 24 * 3600, 24 * 3600


def _events(spark, sf_dir):
    return events_of(table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""
WITH RECURSIVE e AS (SELECT job_id, epoch_us(ts) AS t, event, pct, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM ({_EVENTS})),
r AS (SELECT job_id, rn, t, event, t AS started, 0 AS before, CASE WHEN event = 'step' THEN pct END AS share, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT job_id, rn, t, event, CASE WHEN fresh THEN t ELSE started END, CASE WHEN fresh THEN 0 ELSE share END, CASE WHEN event = 'step' THEN pct END, CASE WHEN fresh THEN 1 ELSE n + 1 END
  FROM (SELECT e.*, r.started, r.share, r.n, r.event <> 'step' OR least(r.t + {IDLE_S}000000, r.started + {LIMIT_S}000000) < e.t AS fresh FROM r JOIN e ON e.job_id = r.job_id AND e.rn = r.rn + 1)),
d AS (SELECT *, least(t + {IDLE_S}000000, started + {LIMIT_S}000000) AS due, lead(t) OVER (PARTITION BY job_id ORDER BY rn) AS next FROM r)
SELECT job_id, started, CASE WHEN event = 'step' THEN due ELSE t END AS ended, CASE event WHEN 'step' THEN 'error' ELSE event END AS status, CASE event WHEN 'done' THEN 100 WHEN 'error' THEN before ELSE share END AS pct,
  CASE WHEN event = 'step' THEN CASE WHEN started + {LIMIT_S}000000 < t + {IDLE_S}000000 THEN 'over the limit' ELSE 'timeout' END END AS message, CAST(n AS BIGINT) AS n_events
FROM d WHERE event <> 'step' OR next IS NULL OR due < next
""")
def job_runs(spark, sf_dir):
    """Each run of each job as it ended: by its last event, or by a timer of a stream where no event came for six hours or the run took a day."""
    return replay(_events(spark, sf_dir), lambda e: L.job_runs(e, IDLE_S, LIMIT_S))


_SUBSCRIPTIONS = "SELECT event_id AS sub_id, user_id AS job_id, epoch_us(ts) + 1800000000 AS since, epoch_us(ts) + 1800000000 + 43200000000 AS until FROM events WHERE event_type = 'view'"


@query(f"""
WITH e AS (SELECT job_id, epoch_us(ts) AS t, event, pct FROM ({_EVENTS})), s AS ({_SUBSCRIPTIONS}),
l AS (SELECT s.*, arg_max(e.event, e.t) AS event, arg_max(e.pct, e.t) AS pct, max(e.t) AS last FROM s LEFT JOIN e ON e.job_id = s.job_id AND e.t <= since GROUP BY ALL),
late AS (SELECT *, event <> 'step' AND since <= last + {DAY_S}000000 AS late FROM l),
stop AS (SELECT sub_id, coalesce(min(e.t), 9e18) AS stop FROM s LEFT JOIN e ON e.job_id = s.job_id AND e.t > since AND e.event <> 'step' GROUP BY sub_id)
SELECT job_id, sub_id, since AS "at", event, CASE WHEN event = 'done' THEN 100 ELSE pct END AS pct FROM late WHERE late
UNION ALL SELECT e.job_id, late.sub_id, e.t, e.event, CASE WHEN e.event = 'done' THEN 100 ELSE e.pct END FROM late JOIN stop USING (sub_id) JOIN e ON e.job_id = late.job_id AND e.t > since AND e.t <= least(until, stop) WHERE NOT coalesce(late, false)
""")
def late_subscribers(spark, sf_dir):
    """What subscribers get who come half an hour after each view and stay for twelve: the terminal event at once if the job has ended within a day, else what follows."""
    events = _events(spark, sf_dir)
    seen = events.where("step = 'view'").select("job_id", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"), (F.col("ts") + F.expr("INTERVAL 750 MINUTES")).alias("until"), F.col("event_id").alias("sub_id"))
    run = Replay(spark, {"events": events.schema, "subscriptions": seen.schema}, lambda e, s: L.deliveries(e, s, DAY_S))
    run.feed(events=events, subscriptions=seen)
    run.close()
    return run.result().withColumn("pct", F.when(F.col("event") == "done", 100).otherwise(F.col("pct")))


@query("""
WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM n GROUP BY user_id, run
""")
def debounced_stream(spark, sf_dir):
    """The last event of each run without a gap of an hour, by session windows of a stream."""
    return replay(_events(spark, sf_dir), lambda e: L.debounced_stream(e, 3_600_000)).select("job_id", "event_id", "n_events")


@query(f"""
WITH p AS (SELECT user_id AS job_id, epoch_us(ts) AS created, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS next FROM events WHERE event_type = 'purchase')
SELECT job_id, created, CASE WHEN next <= created + {DAY_S}000000 THEN next ELSE created + {DAY_S}000000 END AS ended, coalesce(next <= created + {DAY_S}000000, false) AS replaced FROM p
""")
def preview_expiry(spark, sf_dir):
    """When the preview that each purchase makes ended: after a day, by a timer, or with the next one."""
    return replay(_events(spark, sf_dir).where("event = 'done'"), lambda e: L.expiring_previews(e, DAY_S))
