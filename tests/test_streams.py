"""Streams with event time: any cut into batches gives the batch's result, late rows are dropped, nothing is kept of what has ended."""

import datetime as dt
import random

import pytest

from lumenfold.streaming import lifecycle as L
from lumenfold.streaming.replay import Replay

START = dt.datetime(2024, 1, 1)
EVENTS = "job_id long, ts timestamp, event_id long, event string, pct int, message string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def micros(seconds):
    return int((START - dt.datetime(1970, 1, 1)).total_seconds() + seconds) * 1_000_000


def given(n=160, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, -4]), at(rng.randrange(6000)), i, rng.choice(["step"] * 6 + ["done", "error"]), rng.choice([None, 5, 50]), rng.choice([None, "m"])) for i in range(n)]


def runs(rows, idle, limit):
    """Each job's runs, one event at a time."""
    out, held = [], {}

    def lapse(job, now):
        if job in held and (due := min(held[job][1] + idle, held[job][0] + limit)) < now:
            s, last, pct, n = held.pop(job)
            out.append((job, s, due, "error", pct, "over the limit" if s + limit < last + idle else "timeout", n))

    for job, ts, _, event, pct, message in sorted(rows, key=lambda r: r[1:3]):
        now = int((ts - START).total_seconds())
        lapse(job, now)
        s, _, share, n = held.pop(job, (now, now, 0, 0))
        if event == "step":
            held[job] = (s, now, share if pct is None else pct, n + 1)
        else:
            out.append((job, s, now, event, 100 if event == "done" else share, message, n + 1))
    for job in list(held):
        lapse(job, 10**9)
    return sorted((j, micros(a), micros(b), *rest) for j, a, b, *rest in out)


def got(run):
    return sorted(map(tuple, run.result().collect()))


def fed(spark, rows, pieces, schema, compute, delay="2 hours", name="rows"):
    df = spark.createDataFrame([], schema)
    run = Replay(spark, {name: df.schema}, compute, delay=delay)
    for piece in pieces:
        run.feed(**{name: spark.createDataFrame([rows[i] for i in piece], schema)})
    run.close()
    return run


@pytest.mark.parametrize("seed,cuts", [(1, 1), (2, 3)])
def test_runs_under_any_cut(spark, seed, cuts):
    rows = given(seed=seed)
    mixed = random.Random(seed).sample(range(len(rows)), len(rows))
    run = fed(spark, rows, [mixed[k::cuts] for k in range(cuts)], EVENTS, lambda e: L.job_runs(e, 120, 400))
    assert got(run) == runs(rows, 120, 400)
    assert run.state("pending").where("key.job_id IS NOT NULL").count() == 0 and run.state("held").count() == 0


def test_a_silent_job_ends_without_a_next_event_and_late_ones_are_dropped(spark):
    row = lambda job, s, i, event="step": (job, at(s), i, event, 7, None)
    schema = spark.createDataFrame([], EVENTS).schema
    run = Replay(spark, {"rows": schema}, lambda e: L.job_runs(e, 300, 10_000))
    run.feed(rows=spark.createDataFrame([row(1, 0, 0), row(2, 1000, 1)], schema))
    assert got(run) == [(1, micros(0), micros(300), "error", 7, "timeout", 1)]  # by job 2's time alone
    run.feed(rows=spark.createDataFrame([row(1, 900, 2, "done"), row(None, 1100, 3), row(2, 1301, 4)], schema))  # the first is behind the watermark
    run.close()
    assert got(run) == [(1, micros(0), micros(300), "error", 7, "timeout", 1), (2, micros(1000), micros(1300), "error", 7, "timeout", 1), (2, micros(1301), micros(1601), "error", 7, "timeout", 1)]
    assert run.state("held").count() == 0


def test_late_subscribers_get_the_end_at_once(spark):
    events = [(1, at(s), i, e, p, None) for i, (s, e, p) in enumerate([(0, "step", 20), (10, "step", 60), (20, "done", None), (5000, "step", 5)])]
    subs = [(1, at(5), at(1000), 100), (1, at(25), at(1000), 101), (1, at(12), at(15), 102), (1, at(4000), at(6000), 103), (2, at(1), at(9), 104), (1, at(20), at(99), 105), (1, at(10), at(20), 106)]
    e = spark.createDataFrame(events, EVENTS)
    s = spark.createDataFrame(subs, "job_id long, ts timestamp, until timestamp, sub_id long")
    run = Replay(spark, {"events": e.schema, "subscriptions": s.schema}, lambda e, s: L.deliveries(e, s, 3600))
    run.feed(events=e, subscriptions=s)
    run.close()
    t = micros
    want = [(100, t(10), "step", 60), (100, t(20), "done", None), (101, t(25), "done", None), (103, t(5000), "step", 5), (105, t(20), "done", None), (106, t(20), "done", None)]
    assert sorted((r.sub_id, r["at"], r.event, r.pct) for r in run.result().collect()) == want
    assert run.state("held").count() == 0


def test_debounce_as_in_batch_under_any_cut(spark):
    from lumenfold.streaming.jobs import debounced

    rows = given(seed=5)
    want = sorted(r.event_id for r in debounced(spark.createDataFrame(rows, EVENTS), 60_000, ["ts", "event_id"]).collect())
    mixed = random.Random(3).sample(range(len(rows)), len(rows))
    run = fed(spark, rows, [mixed[:50], mixed[50:]], EVENTS, lambda e: L.debounced_stream(e, 60_000))
    assert sorted(r.event_id for r in run.result().collect()) == want and sum(r.n_events for r in run.result().collect()) == len(rows)


def test_previews_expire_by_timer_or_by_a_newer_one(spark):
    rows = [(1, at(s), i, "done", None, None) for i, s in enumerate([0, 100, 700, 2000])] + [(2, at(50), 9, "done", None, None)]
    run = fed(spark, rows, [[4, 2, 0], [1, 3]], EVENTS, lambda e: L.expiring_previews(e, 600))
    assert got(run) == [(1, micros(0), micros(100), True), (1, micros(100), micros(700), True), (1, micros(700), micros(1300), False), (1, micros(2000), micros(2600), False), (2, micros(50), micros(650), False)]
    assert run.state("held").count() == 0
