"""Arrays, nested values and defaults, Column to Column."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_array(c: Column) -> Column:
    """Null gives an empty array, another value one of itself."""
    return F.when(c.isNull(), F.array()).otherwise(F.array(c))


def json_to_array(c: Column, keep_empty: bool = True, scalars: bool = True, single: bool = True) -> Column:
    """JSON text as an array of JSON texts: an array's items, a value itself, nothing for null.

    keep_empty: keep null, '' and {} in an array. scalars: wrap strings and numbers. single: wrap one object.
    """
    j = F.trim(c)
    kind = F.substring(j, 1, 1)
    items = F.transform(F.from_json(j, "array<variant>"), lambda v: F.to_json(v))
    blank = lambda x: x.isNull() | x.isin("null", "{}", '""', "[]")
    kept = items if keep_empty else F.filter(items, lambda x: ~blank(x))
    empty = F.array().cast("array<string>")
    return (
        F.when(j.isNull() | j.isin("null", "", '""', "{}"), empty)
        .when(kind == "[", F.coalesce(kept, empty))
        .when(kind == "{", F.array(j) if single else empty)
        .otherwise(F.array(j) if scalars else empty)
    )


def compact(c: Column) -> Column:
    """An array of strings without null and blank items."""
    return F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))


def default_fill(df: DataFrame, value: str = "") -> DataFrame:
    """Every null string, also in structs and in arrays of structs, becomes value."""

    def filled(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(c, F.lit(value))
        if isinstance(kind, T.StructType):
            return F.struct(*[filled(c[f.name], f.dataType).alias(f.name) for f in kind])
        if isinstance(kind, T.ArrayType):
            return F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: filled(x, kind.elementType))
        return c

    return df.select(*[filled(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def useful_value(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(c) != "")


def has_useful_value(values: Column) -> Column:
    """Whether any of the leaves, an array of strings, is not blank; a null leaf counts as the text null."""
    return F.exists(values, lambda v: F.trim(F.coalesce(v, F.lit("null"))) != "")


def useful_within(c: Column, kind: T.DataType, null_is_useful: bool = True) -> Column:
    """Whether a nested value holds anything useful, by an expression that follows its type: null and empty ones at the top hold nothing.

    Within it, an array is useful if it has items, an object if any of its values is, and another value if its text isn't blank. A null value there has the
    text null, and so counts, unless null_is_useful is off, for rows in which null stands for what is absent.
    """

    def useful(c: Column, kind: T.DataType) -> Column:
        null = F.lit(null_is_useful)
        if isinstance(kind, T.ArrayType):
            return F.when(c.isNull(), null).otherwise(F.size(c) > 0)
        if isinstance(kind, (T.StructType, T.MapType)):
            return F.when(c.isNull(), null).otherwise(any_of(c, kind))
        if isinstance(kind, T.StringType):
            return F.when(c.isNull(), null).otherwise(c.rlike(r"[^\s\x1c-\x1f\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"))
        return F.when(c.isNull(), null).otherwise(F.lit(True))

    def any_of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType):
            return F.exists(F.map_values(c), lambda v: useful(v, kind.valueType))
        out = F.lit(False)
        for f in kind:
            out = out | useful(c.getField(f.name), f.dataType)
        return out

    if not isinstance(kind, (T.StructType, T.MapType)):
        raise ValueError("only a struct or a map has values within")
    return F.coalesce(any_of(c, kind), F.lit(False)) & c.isNotNull()


def any_true(values: Column) -> Column:
    """Whether any item is true, or the text true."""
    return F.exists(values, lambda v: F.lower(v.cast("string")) == "true")


def string_to_bool(c: Column) -> Column:
    return F.lower(c.cast("string")) == "true"


def slice_halves(c: Column) -> Column:
    """(left, right); the left half has the middle item."""
    n = F.size(c)
    cut = F.ceil(n / 2).cast("int")
    return F.struct(F.slice(c, 1, cut).alias("left"), F.when(n > cut, F.slice(c, cut + 1, n - cut)).otherwise(F.slice(c, 1, 0)).alias("right"))


def distinct_joined(c: Column, separator: str = ", ") -> Column:
    """Trimmed distinct items that aren't blank, in first-seen order, joined."""
    return F.array_join(F.array_distinct(compact(F.transform(c, lambda x: F.trim(x)))), separator)


def first_or(c: Column, default: str = "—") -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(default))


def subtitle_and_rest(c: Column, variant: str = "first") -> Column:
    """(subtitle, items): the first and the rest; 'several': all if there are more than one; 'all': all."""
    n = F.size(c)
    if variant == "first":
        return F.struct(F.try_element_at(c, F.lit(1)).alias("subtitle"), F.when(n > 1, F.slice(c, 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(c, 1, 0)).alias("items"))
    return F.struct(F.lit(None).cast("string").alias("subtitle"), (F.when(n > 1, c).otherwise(F.slice(c, 1, 0)) if variant == "several" else c).alias("items"))


def _leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
    children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if children is None:
        yield path, "" if value is None else str(value)
        return
    for key, child in children:
        yield from _leaves(child, f"{path}.{key}" if path else str(key))


_LEAF = T.StructType([T.StructField("idx", T.LongType()), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])


@F.pandas_udf(T.ArrayType(_LEAF))
def _flattened(s: pd.Series) -> pd.Series:
    def one(text: str | None):
        try:
            found = dict(_leaves(json.loads(text), "")) if text else {}
        except ValueError:
            return None
        return [{"idx": k, "path": p, "value": v} for k, (p, v) in enumerate(found.items())]

    return s.map(one)


def flatten_json(c: Column) -> Column:
    """(idx, path, value) of each leaf: dotted paths with numbers for array items; values as Python prints them (True, 1000.0), null as ''.

    Empty objects and arrays have no leaves; of equal paths the last value stays; null for what is no JSON.
    """
    return _flattened(c)
