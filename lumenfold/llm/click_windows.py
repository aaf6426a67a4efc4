"""Expiring click deduplication: a punctuated stream whose control rows close the windows that a MapState of each bucket holds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.llm._shared import SALTS, saved
from lumenfold.operators.written import new_path

BATCHES, WINDOW, LATE = 10, 48, 24
BUCKET_ROWS, HOT_ROWS = 20_000, 10_000
FOREVER = 2**62
OUTPUT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
WINDOW_STATE = ["start_hour", "hash", "n_repeats", "n_conflicts", "conflict_crc"]
FED = "bucket long, batch long, punctuation long, click_id long, hour long, hash binary, n long, crc long"


def utc_micros(name: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"CAST(CAST(CAST(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000000 AS BIGINT)")
    return F.unix_micros(name)


def click_copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, at, hash) of all copies: j of 0 to click_id % 3, `at` the hour at which a copy comes in.

    The hash is the digest's 32 bytes. A row without click_id or arrived_at has no hour and so no copies; a value that is no finite number counts as
    null; a negative click_id is taken modulo 3 from above.
    """
    kinds = {f.name: f.dataType for f in clicks.schema}
    cents = F.when(F.col("value") - F.col("value") == 0, F.floor(100 * F.col("value") + 0.5))
    parts = [F.col("client_id"), F.col("kind"), cents, utc_micros("ts", kinds["ts"]), F.col("props")]
    rows = clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL").select(
        F.col("click_id").cast("long"),
        F.floor(utc_micros("arrived_at", kinds["arrived_at"]) / 3_600_000_000).alias("_lf_hour"),
        F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("|")) for p in parts)).alias("_lf_body"),
        F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))).alias("_lf_j"),
    )
    c = F.crc32(F.concat(F.col("click_id").cast("string"), F.lit(":"), F.col("_lf_j").cast("string")).cast("binary"))
    rows = rows.withColumn("_lf_c", c).withColumn("hour", F.col("_lf_hour") + 6 * F.col("_lf_j") * (F.col("_lf_c") % 10))
    digest = F.unhex(F.sha2(F.concat("_lf_body", (F.col("_lf_c") % 3).cast("string")).cast("binary"), 256))
    return rows.select("click_id", "hour", (F.col("hour") + F.floor(F.col("_lf_c") / 10) % 200).alias("at"), digest.alias("hash"))


class ExpiringWindows(StatefulProcessor):
    """A bucket's windows, by click_id in a MapState: first the batch's copies by click_id, hour and hash, then its punctuation, which closes."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = [T.StructField(c, T.BinaryType() if c == "hash" else T.LongType()) for c in WINDOW_STATE]
        self.open = handle.getMapState("open", T.StructType([T.StructField("click_id", T.LongType())]), T.StructType(value))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802
        import pandas as pd

        copies, batch, until = [], None, None
        for df in rows:
            told = df["punctuation"].notna()
            if told.any():
                batch, until = int(df.loc[told, "batch"].iloc[0]), int(df.loc[told, "punctuation"].iloc[0])
            df = df[~told]
            hashes = [(h is None, b"" if h is None else bytes(h)) for h in df["hash"]]  # those without stand behind the others
            copies += zip(*(df[c].astype("int64").tolist() for c in ("click_id", "hour")), hashes, *(df[c].astype("int64").tolist() for c in ("n", "crc")), strict=True)
        copies.sort()
        kept = {k[0]: (v[0], bytes(v[1]), *v[2:]) for k, v in self.open.iterator()}
        windows, closed = {k: list(v) for k, v in kept.items()}, []
        for click, hour, (several, digest), n, crc in copies:
            w = windows.get(click)
            if w is None or hour > w[0] + self.window:
                if w is not None:
                    closed.append((click, *w))
                windows[click] = w = [hour, digest, -1, 0, 0]
            w[2] += n
            if several or digest != w[1]:
                w[3] += n
                w[4] += crc if several else n * zlib.crc32(digest.hex().encode())
        if until is not None:
            for click in [k for k, w in windows.items() if w[0] + self.window < until]:
                closed.append((click, *windows.pop(click)))
        for click in kept.keys() - windows.keys():
            self.open.removeKey((click,))
        for click, w in windows.items():
            if kept.get(click) != tuple(w):
                self.open.updateValue((click,), tuple(w))
        if closed:
            out = pd.DataFrame(closed, columns=["click_id", *WINDOW_STATE])
            yield out.assign(hash=out["hash"].map(bytes.hex), closed_batch=batch)[[x.split()[0] for x in OUTPUT.split(", ")]]

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, **more: str):
    """Settings of the session while a query starts and runs; those before come back."""
    before = {k: spark.conf.get(k, None) for k in more}
    try:
        for k, v in more.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _few_hashes(cut: DataFrame, hot_rows: int) -> DataFrame:
    """cut (batch, click_id, hour, hash, n) with crc, where a click_id of over hot_rows rows in a batch has few: hashes that open no window are added up.

    Only the least hash of an hour in a batch can open a window. So of such click_ids the hashes that are least somewhere stay, and the others of each hour are one row
    without a hash, with their number and the sum of their CRCs: wherever they fall, they are conflicts. A click_id's rows in a batch are then bounded by
    its hours. The joins go by click_id and hash, which spreads one click_id's rows.
    """
    crc = F.crc32(F.lower(F.hex("hash")).cast("binary"))
    plain = cut.withColumn("crc", F.lit(0).cast("long"))
    hot = saved(cut.groupBy("batch", "click_id").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).select("click_id").distinct(), "hot-clicks")
    if hot.isEmpty():
        return plain
    own = cut.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int"))
    many = hot.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = saved(own.join(many.hint("merge"), ["click_id", "salt"]).drop("salt"), "hot-copies")
    openers = rows.groupBy("batch", "click_id", "hour").agg(F.min("hash").alias("hash")).select("click_id", "hash", F.lit(True).alias("opens")).distinct()
    told = rows.join(openers.hint("merge"), ["click_id", "hash"], "left").withColumn("crc", F.when(F.col("opens"), 0).otherwise(F.col("n") * crc))
    few = told.groupBy("batch", "click_id", "hour", F.when(F.col("opens"), F.col("hash")).alias("hash")).agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    rest = plain.join(hot.hint("merge"), "click_id", "left_anti")
    return saved(rest.unionByName(few), "few-copies", by="batch")


def expiring_windows(copies: DataFrame, batches: int = BATCHES, window: int = WINDOW, late: int = LATE, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deduplication windows of copies (click_id, hour, at, hash) that come in by `at`, in equal spans of it.

    The copies are cut into batches once. Equal copies of a batch are counted before anything is dealt out by click_id. Each batch's files and one control row for each bucket then go
    into the source folder, and the query starts anew on its checkpoint. It drops late copies before the shuffle, deals the rest out by bucket of
    click_ids, and each bucket's processor first takes the copies and then the control row, whose M closes windows; there is no watermark.
    Buckets are as many as keep a batch's share of each under bucket_rows, whatever the size. What goes to the driver: the least and greatest `at`, and one row
    a batch. A task holds the (hour, hash) of the click_ids of one bucket in one batch, of which a click_id with over hot_rows has few (_few_hashes).
    """
    spark = copies.sparkSession
    ends = copies.agg(F.min("at"), F.max("at")).first()
    if ends[0] is None:
        return spark.createDataFrame([], OUTPUT)
    first, span = ends[0], ends[1] - ends[0] + 1
    cut = copies.withColumn("batch", F.floor((F.col("at") - first) * batches / span).cast("int"))
    cut = saved(cut.groupBy("batch", "click_id", "hour", "hash").agg(F.count("*").alias("n")), "copies", by="batch")
    cut = _few_hashes(cut, hot_rows)
    facts = {r.batch: r for r in cut.groupBy("batch").agg(F.max("hour").alias("most"), F.count("*").alias("rows")).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(r.rows for r in facts.values()) // bucket_rows))
    source, out, checkpoint = (new_path(spark, f"windows-{x}") for x in ("source", "closed", "checkpoint"))
    most = None
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store takes megabytes of disk ahead
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    with settings(spark, **conf):
        for b in range(batches):
            dropped = None if most is None else most - late
            most = max([x for x in (most, facts[b].most if b in facts else None) if x is not None])
            until = FOREVER if b == batches - 1 else most - late
            control = spark.range(0, buckets, 1, 1 + buckets // 10_000).select(F.col("id").alias("bucket"), F.lit(b).cast("long").alias("batch"), F.lit(until).cast("long").alias("punctuation"), *(F.lit(None).cast(t).alias(c) for c, t in (("click_id", "long"), ("hour", "long"), ("hash", "binary"), ("n", "long"), ("crc", "long"))))
            data = cut.where(F.col("batch") == b).select(F.pmod(F.xxhash64("click_id"), F.lit(buckets)).alias("bucket"), F.col("batch").cast("long").alias("batch"), F.lit(None).cast("long").alias("punctuation"), "click_id", "hour", "hash", "n", "crc")
            data.unionByName(control).write.mode("append").parquet(source)
            fed = spark.readStream.schema(FED).parquet(source)
            if dropped is not None:
                fed = fed.where(F.col("punctuation").isNotNull() | (F.col("hour") >= dropped))
            closed = fed.groupBy("bucket").transformWithStateInPandas(ExpiringWindows(window), OUTPUT, "append", "none")
            closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(out)


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all clicks' copies, fed in ten batches. Repeated rows have copies of their own; without clicks there are no windows."""
    return expiring_windows(click_copies(spark.read.parquet(f"{sf_dir}/clicks.parquet")))
