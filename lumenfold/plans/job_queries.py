"""Jobs from events: a user's events are a job's."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators.written import new_path
from lumenfold.plans.registry import query, table
from lumenfold.streaming import jobs as X

_EVENTS = "SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'step' END AS event, CAST(event_id % 100 AS INTEGER) AS pct FROM events"


def events_of(df):
    """The events of the table as job events."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("step")
    return df.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("event"), F.col("event_type").alias("step"), (F.col("event_id") % 100).cast("int").alias("pct"), F.lit(None).cast("string").alias("message"))


@query(f"""
WITH e AS ({_EVENTS}), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT job_id, event, CASE WHEN event = 'done' THEN 100 ELSE pct END AS pct, CASE event WHEN 'step' THEN 'running' ELSE event END AS status FROM l
""")
def job_latest_state(spark, sf_dir):
    """Each job's last event and status."""
    return X.latest_state(events_of(table(spark, sf_dir, "events")), ["ts", "event_id"]).select("job_id", "event", "pct", "status")


@query("""
SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 300000000, false) AS timed_out FROM events
""")
def job_timeouts(spark, sf_dir):
    """Events after more than the idle time."""
    return X.with_timeouts(events_of(table(spark, sf_dir, "events")), order=["ts", "event_id"]).select("event_id", "timed_out")


@query("SELECT user_id AS job_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, epoch_us(max(ts)) - epoch_us(min(ts)) > 300000000 AS over FROM events GROUP BY user_id")
def job_durations(spark, sf_dir):
    """How long each job took."""
    return X.durations(events_of(table(spark, sf_dir, "events"))).select("job_id", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"), "over")


@query("SELECT event_id FROM events QUALIFY coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) >= 3600000000, true)")
def debounced_events(spark, sf_dir):
    """The last event of each run without a gap of an hour."""
    return X.debounced(events_of(table(spark, sf_dir, "events")), 3_600_000, ["ts", "event_id"]).select("event_id")


@query(f"""
WITH e AS ({_EVENTS}), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT job_id, event, CASE WHEN event = 'done' THEN 100 ELSE pct END AS pct, CASE event WHEN 'step' THEN 'running' ELSE event END AS status FROM l
""")
def job_state_stream(spark, sf_dir):
    """job_latest_state by a stream over the events' files; each micro-batch writes the states that it changed."""
    out = new_path(spark, "states")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    states = X.latest_state(events_of(stream), ["ts", "event_id"]).select("job_id", "event", "pct", "status")
    kept = states.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    started = kept.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/states/epoch={epoch}")).start()
    started.awaitTermination()
    every = spark.read.parquet(f"{out}/states")
    return every.groupBy("job_id").agg(F.max_by(F.struct("event", "pct", "status"), "epoch").alias("s")).select("job_id", "s.*")
