"""Template bindings as DataFrame operations: rows for repetitions, filters for conditions, prefixes for scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def foreach(df: DataFrame, path: str, item: str = "item", index: str = "index", keep: list[str] | None = None) -> DataFrame:
    """A row for each item of an array, with the outer columns (parent, root) beside it; null and empty arrays give none."""
    return df.select(*(keep if keep is not None else df.columns), F.posexplode(path).alias(index, item))


def when(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true."""
    return df.where(F.coalesce(condition, F.lit(False)))


def unless(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition isn't true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def scope(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The fields of a struct as columns, beside keep; rows where it is null drop out."""
    return df.where(F.col(path).isNotNull()).select(*(keep or []), f"{path}.*")


def visible(df: DataFrame, condition: Column, flag: str = "visible") -> DataFrame:
    """All rows, with a flag."""
    return df.withColumn(flag, F.coalesce(condition, F.lit(False)))


def numbered_id(prefix: str, index: Column) -> Column:
    """An id made of a prefix and an index."""
    return F.concat(F.lit(prefix), index.cast("string"))


def text(*parts: Column | str) -> Column:
    """Texts and values in a row; null is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
