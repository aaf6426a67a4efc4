"""Streaming computations over tables: what is there is fed, and a row of a later time closes what is open."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.written import new_path

#: Settings of a query with state: stores on disk that take none ahead, and batches without data, in which timers and windows end.
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}
# A fixed value: later than any event, and still in the range of nanoseconds that pandas has.
END = "2250-01-01 00:00:00"


@contextmanager
def settings(spark: SparkSession, more: dict[str, str]):
    """Settings of the session while queries start and run; those before come back."""
    before = {k: spark.conf.get(k, None) for k in more}
    try:
        for k, v in more.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Replay:
    """A streaming computation over rows that are given to it piece by piece, on one checkpoint.

    compute takes streaming DataFrames, one for each of `sources` (name: schema of the rows), with a watermark on `time` that lags by `delay`, and gives
    what is written, in append mode. Each call of feed() is a start of the query that ends when it has read all.
    """

    def __init__(self, spark: SparkSession, sources: dict, compute: Callable[..., DataFrame], time: str = "ts", delay: str = "0 seconds", files_at_once: int | None = None) -> None:
        self.spark, self.sources, self.compute, self.time, self.delay, self.files = spark, sources, compute, time, delay, files_at_once
        self.at = {k: new_path(spark, f"fed-{k}") for k in sources}
        self.out, self.checkpoint = new_path(spark, "replayed"), new_path(spark, "checkpoint")
        for k, schema in sources.items():
            spark.createDataFrame([], schema).write.parquet(self.at[k])

    def feed(self, **rows: DataFrame) -> None:
        for k, df in rows.items():
            df.select(*self.sources[k].names).write.mode("append").parquet(self.at[k])
        with settings(self.spark, STATEFUL):
            streams = []
            for k, schema in self.sources.items():
                reader = self.spark.readStream.schema(schema)
                reader = reader.option("maxFilesPerTrigger", self.files) if self.files else reader
                streams.append(reader.parquet(self.at[k]).withWatermark(self.time, self.delay))
            out = self.compute(*streams)
            self.schema = out.schema
            out.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    def close(self) -> None:
        """Feeds a row that holds nothing but a time behind all others, so that whatever waits for the watermark ends."""
        last = {k: self.spark.range(1).select(*(F.to_timestamp(F.lit(END)).cast(f.dataType).alias(f.name) if f.name == self.time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)) for k, schema in self.sources.items()}
        self.feed(**last)

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.out)

    def state(self, variable: str | None = None) -> DataFrame:
        """What the query still holds: a state variable of its processor, or its only state."""
        reader = self.spark.read.format("statestore").option("path", self.checkpoint)
        with settings(self.spark, STATEFUL):
            return (reader.option("stateVarName", variable) if variable else reader).load()


def replay(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """compute over a table as one stream: all rows, then the end."""
    run = Replay(rows.sparkSession, {"rows": rows.schema}, compute, time, delay)
    run.feed(rows=rows)
    run.close()
    return run.result()
