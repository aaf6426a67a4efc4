"""Keyed settings: layouts, chart configurations and the current project, kept as one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, version long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def put(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """settings with the rows of changes (key, value); of equal keys in changes the larger value stays."""
    top = settings.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    new = changes.groupBy("key").agg(F.max("value").alias("value")).crossJoin(F.broadcast(top)).select("key", "value", (F.col("top") + 1).alias("version"))
    every = settings.unionByName(new)
    return every.groupBy("key").agg(F.max_by(F.struct("value", "version"), "version").alias("s")).select("key", "s.value", "s.version")


def remove(settings: DataFrame, keys: DataFrame) -> DataFrame:
    return settings.join(keys.select("key").distinct(), "key", "left_anti")


def save(settings: DataFrame, path: str) -> None:
    settings.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def reset(spark: SparkSession, path: str) -> None:
    """Forgets all keys."""
    save(empty(spark), path)
