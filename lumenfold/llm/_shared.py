"""Grouped Arrow streams and connected components over written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm._text import lean, string_bytes
from lumenfold.operators.written import drop, saved

SALTS = 8
__all__ = ["components", "drop", "extended", "grouped", "in_groups", "saved"]


def extended(schema: T.StructType, more: str, without: tuple[str, ...] = ()) -> T.StructType:
    """The fields of a schema, but for some, and those of a DDL string."""
    return T.StructType([f for f in schema if f.name not in without] + T.StructType.fromDDL(more).fields)


def grouped(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], at_once: int = 0, weigh: str | None = None) -> Callable:
    """A mapInArrow function over rows sorted by keys: work gets tables of whole groups.

    Each table holds one group, or, with at_once, as many whole groups as come to that many rows, or to that many bytes of the
    column `weigh`. What is held is one batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            ends = np.append(_breaks(table, keys) + 1, table.num_rows)
            if at_once:
                so_far = ends if weigh is None else string_bytes(table.column(weigh))[1][ends]
                part = (so_far - 1) // at_once
                ends = ends[np.append(part[1:] != part[:-1], True)]
            cuts = [0, *ends.tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from filter(None, [work(table.slice(a, b - a))])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if weigh is None and rows < at_once:
                continue
            table = pa.concat_tables(held).combine_chunks()
            at = _breaks(table, keys)
            if len(at):
                last = int(at[-1]) + 1
                yield from done(table.slice(0, last))
                table = table.slice(last)
            held, rows = [table], table.num_rows
        if held:
            yield from done(pa.concat_tables(held).combine_chunks())

    return run


def _breaks(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows after which a key changes."""
    out = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        out |= v[1:] != v[:-1]
    return np.flatnonzero(out)


def in_groups(df: DataFrame, keys: list[str], work: Callable, schema: str, at_once: int = 0, weigh: str | None = None) -> DataFrame:
    """work on df's groups by keys."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(grouped(keys, work, at_once, weigh)), schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star rounds; each is an aggregation and a join over the
    edges, so neither the driver nor one task holds a component. Nodes without edges are absent.
    """

    def measured(df: DataFrame, name: str) -> tuple[DataFrame, dict]:
        said = Observation()
        out = saved(df.observe(said, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")), f"{name}-edges")
        return out, said.get

    now, state = measured(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), name)
    seen = None
    while state["n"] and state != seen:
        least = now.union(now.select("lo", "hi")).toDF("u", "v").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Dealt out by a salt, so that the edges of one node meet in several tasks.
        least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = now.withColumn("at", F.pmod(F.xxhash64("hi"), F.lit(SALTS)).cast("int"))
        large = salted.join(least, (salted.lo == least.u) & (salted["at"] == least.salt)).select("hi", F.col("m").alias("lo")).distinct()
        lowest = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        pairs = large.join(lowest, large.hi == lowest.u)
        small = pairs.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi > lo").distinct()
        seen, before = state, now
        now, state = measured(small, name)
        drop(before)
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(now.select("lo", "lo").distinct())
