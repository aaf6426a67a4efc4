import datetime as dt
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import click_windows as W

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def brute(rows, batches=10):
    """The contract, one copy at a time."""
    micros = lambda t: (t - EPOCH) // dt.timedelta(microseconds=1)
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        cents = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            body = "|".join("" if x is None else str(x) for x in (client, kind, cents, None if ts is None else micros(ts), props, c % 3))
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256(body.encode()).hexdigest()))
    if not copies:
        return []
    lo, hi = min(copies)[0], max(copies)[0]
    cut = [[c for c in copies if (c[0] - lo) * batches // (hi - lo + 1) == b] for b in range(batches)]
    windows, out, m = {}, [], None
    for b, mine in enumerate(cut):
        for _, click, hour, h in sorted(mine, key=lambda c: c[1:]):
            if m is not None and hour < m - 24:
                continue
            w = windows.get(click)
            if w and hour <= w[0] + 48:
                w[1] += 1
                if h != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(h.encode())
                continue
            if w:
                out.append((click, w[0], b, *w[1:]))
            windows[click] = [hour, 0, 0, 0, h]
        m = max([c[2] for c in mine] + ([] if m is None else [m]))
        for click in [k for k, w in windows.items() if b == batches - 1 or w[0] + 48 < m - 24]:
            w = windows.pop(click)
            out.append((click, w[0], b, *w[1:]))
    return sorted(out)


def given(n, seed=5):
    rng = random.Random(seed)
    at = lambda h: EPOCH + dt.timedelta(days=19_700, hours=h, seconds=rng.randrange(3600))
    rows = []
    for _ in range(n):
        h = rng.randrange(900)
        click = rng.choice([1, 2, 5, -4, 0, *range(10, 60)])  # 2 and 5 have many copies
        rows.append((click, rng.choice([at(h), None]), at(h), rng.choice([7, None]), rng.choice(["a|b", None, ""]), rng.choice([1.005, -2.5, None, math.inf, math.nan]), rng.choice(["{}", None])))
    return [*rows, *rows[:40], (None, at(1), at(1), 1, "k", 1.0, "p"), (3, at(1), None, 1, "k", 1.0, "p")]


def result(df):
    return sorted((r.click_id, r.start_hour, r.closed_batch, r.n_repeats, r.n_conflicts, r.conflict_crc, r.hash) for r in df.collect())


def test_query_over_odd_rows_as_one_copy_at_a_time(spark, tmp_path):
    rows = given(600)
    clashing = {c: F.lit(1) for c in ("hour", "batch", "bucket", "at", "hash")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clashing).write.parquet(f"{tmp_path}/clicks.parquet")
    assert result(W.op12_click_windows(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("batches,bucket_rows", [(1, 20_000), (3, 50)])
def test_other_cuts_and_more_buckets(spark, batches, bucket_rows):
    rows = given(150, seed=batches)
    got = W.expiring_windows(W.click_copies(spark.createDataFrame(rows, SCHEMA)), batches, bucket_rows=bucket_rows)
    assert result(got) == brute(rows, batches)


def test_a_click_with_most_rows_keeps_few_hashes(spark):
    rng = random.Random(9)
    rows = given(100) + [(5, None, EPOCH + dt.timedelta(days=19_700, hours=rng.randrange(160)), 1, "k", float(rng.randrange(40)), None) for _ in range(1500)]
    df = W.click_copies(spark.createDataFrame(rows, SCHEMA))
    assert result(W.expiring_windows(df, 3, hot_rows=50)) == brute(rows, 3)
    cut = df.groupBy(F.lit(0).alias("batch"), "click_id", "hour", "hash").agg(F.count("*").alias("n"))
    few = W._few_hashes(cut, 50)
    assert few.agg(F.sum("n")).first()[0] == df.count() and few.where("click_id = 5 and hash is null").count() > 20 and few.where("click_id = 5").count() < cut.where("click_id = 5").count() * 0.8


def test_one_hour_and_no_clicks(spark):
    one = [(0, EPOCH, EPOCH, None, None, None, None)] * 3
    assert result(W.expiring_windows(W.click_copies(spark.createDataFrame(one, SCHEMA)))) == brute(one)
    assert result(W.expiring_windows(W.click_copies(spark.createDataFrame([], SCHEMA)))) == []


def test_times_in_another_zone(spark):
    rows = given(30)
    with W.settings(spark, **{"spark.sql.session.timeZone": "America/Sao_Paulo"}):
        a = sorted(map(tuple, W.click_copies(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert a == sorted(map(tuple, W.click_copies(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_settings_come_back(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), W.settings(spark, **{key: "false"}):
        1 / 0
    assert spark.conf.get(key) == before
