"""Intermediate tables, written once and read by several steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a fresh one of this machine, but only if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lumenfold.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.lumenfold.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; cuts the lineage. by: a column that its folders are named after.

    What is random or depends on the partitioning is then the same for all that read it. The file lasts as
    long as the session, as lazy results still read it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what saved() wrote for df."""
    path = getattr(df, "_lf_path", None)
    for item in [x for x in _written if x[1] == path]:
        _written.remove(item)
        _delete(*item)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


@atexit.register
def _clean() -> None:
    for item in _written:
        _delete(*item)
    _written.clear()
