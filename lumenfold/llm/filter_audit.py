"""Interaction of filters: packed bitmaps of each partition, AND-NOT and popcounts by subset of filters, sums over partitions."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import extended, saved
from lumenfold.llm._text import lean

FILTERS = "ABCDE"
#: The bytes that filter C counts, and those that filter D looks for.
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
PIECE = 4 << 20


def _words(b: bytes) -> tuple[int, int]:
    """How many words, and how many different ones; a long text goes a piece at a time. bytes.split() splits at the six blanks of ASCII."""
    if len(b) <= PIECE:
        w = b.split()
        return len(w), len(set(w))
    n, seen, rest = 0, set(), b""
    for a in range(0, len(b), PIECE):
        rest += b[a : a + PIECE]
        w = rest.split()
        rest = w.pop() if w and not rest[-1:].isspace() and a + PIECE < len(b) else b""
        n += len(w)
        seen.update(w)
    return n, len(seen)


def text_failures(text: str | None) -> int:
    """Bits of the filters A to D that a text fails: A is bit 0."""
    b = (text or "").encode()
    n, different = _words(b)
    short, repetitive = n < 200, 100 * different < 50 * n
    shouting = 100 * (len(b) - len(b.translate(None, CAPITALS))) > 3 * len(text or "")
    return short | repetitive << 1 | shouting << 2 | (len(b.translate(None, SYMBOLS)) < len(b)) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags, digests = [], []
        for t in batch.column("text"):
            text = t.as_py()
            flags.append(text_failures(text))
            digests.append(hashlib.sha256((text or "").encode()).digest())
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(flags, pa.int32()), pa.array(digests, pa.binary())], [*names, "failed", "digest"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, digest) of docs: the filters A to D by text, E where a smaller doc_id has an identical text.

    The first id of each text is found by an aggregation over digests (SHA-256), which combines before it shuffles, and joined back by id, so that
    no task holds a group of equal texts. A row without a doc_id is not larger than any and passes E; rows that repeat the
    first id with its text all pass.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = saved(rows.mapInArrow(lean(_judged), extended(rows.schema, "failed int, digest binary", ("text",))), "judged")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("_lf_first"))
    named = rows.where("doc_id IS NOT NULL").join(first.hint("merge"), ["doc_id", "digest"], "left")
    named = named.select("doc_id", "part", F.when(F.col("_lf_first"), F.col("failed")).otherwise(F.col("failed") + 16).alias("failed"))
    return named.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", "failed"))


def _bits(x: np.ndarray) -> np.ndarray:
    """Booleans as a bitmap of 64-bit words."""
    out = np.packbits(x)
    return np.concatenate([out, np.zeros(-len(out) % 8, np.uint8)]).view(np.uint64)


def _popcount(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def _counted(filters: int, labels: list[str]):
    """Popcounts of each part and subset of the filters: the rows that pass them all, and those of them with each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            failed = batch.column("failed").to_numpy()
            fails = [_bits(failed >> f & 1 == 1) for f in range(filters)]
            told = [_bits(batch.column(c).to_numpy(zero_copy_only=False).astype(bool)) for c in labels]
            parts = batch.column("part").dictionary_encode()
            at = parts.indices.to_numpy()
            for k, part in enumerate(parts.dictionary.to_pylist()):
                left = {0: _bits(at == k)}
                n = totals.setdefault(part, np.zeros((1 << filters, 1 + len(labels)), np.int64))
                for s in range(1 << filters):
                    if s:  # one AND-NOT behind the subset without its highest filter
                        top = s.bit_length() - 1
                        left[s] = left[s ^ 1 << top] & ~fails[top]
                    n[s] += [_popcount(left[s]), *(_popcount(left[s] & x) for x in told)]
        if totals:
            subset = np.tile(np.arange(1 << filters, dtype=np.int32), len(totals))
            table = np.concatenate(list(totals.values()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(totals), 1 << filters), pa.string()), pa.array(subset), *(pa.array(table[:, i]) for i in range(1 + len(labels)))], ["part", "subset", "n", *labels])

    return run


def subset_counts(rows: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """(part, subset, n, labels...): how many rows of each part pass all filters of a subset (bit i: filter i).

    rows: part, `failed` (bits of failed filters) and boolean label columns. Bitmaps live in a task for one Arrow batch; a task gives one row
    for each part and subset that it met, and these are summed.
    """
    kinds = "".join(f", {c} long" for c in labels)
    tasks = rows.select("part", "failed", *labels).mapInArrow(lean(_counted(filters, labels)), f"part string, subset int, n long{kinds}")
    return tasks.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", *labels)))


def filter_audit(rows: DataFrame, names: str, good: str, bad: str) -> DataFrame:
    """Every order of the filters, step by step, for each part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    names: a letter for each filter. The orders (n! of them, n steps each) are a fixed table that meets the counts by the subsets before and after
    a step. shapley sums a filter's removals over all orders: a subset of k filters before it stands in k! (n-1-k)! of them.
    """
    n, every = len(names), (1 << len(names)) - 1
    counts = saved(subset_counts(rows, n, [good, bad]), "counts")
    spark = rows.sparkSession
    steps, before = [], {}
    for order in itertools.permutations(range(n)):
        s = 0
        for i, f in enumerate(order):
            steps.append(("".join(names[x] for x in order), i + 1, f, s, s | 1 << f))
            before[f, s] = math.factorial(bin(s).count("1")) * math.factorial(n - 1 - bin(s).count("1"))
            s |= 1 << f
    order = spark.createDataFrame(steps, "filter_order string, step int, f int, s int, t int")
    pairs = spark.createDataFrame([(f, s, s | 1 << f, w) for (f, s), w in before.items()], "f int, s int, t int, w long")
    kinds = ["n", good, bad]
    at = {k: counts.select("part", F.col("subset").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in kinds)) for k in ("s", "t")}
    # What each filter does in each place, by the subsets before and behind it: n * 2^(n-1) rows a part.
    moved = at["s"].join(F.broadcast(pairs), "s").join(at["t"], ["part", "t"]).withColumn("removed", F.col("n_s") - F.col("n_t"))
    of = moved.groupBy("part", "f").agg(
        F.sum(F.col("removed") * F.col("w")).alias("shapley"),
        F.sum(F.when(F.col("s") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("t") == every, F.col("removed"))).alias("unique_fails"),
    )
    moved = moved.join(of, ["part", "f"])
    taken = moved.join(F.broadcast(order), ["f", "s", "t"])
    return taken.select(
        "part", "filter_order", "step", F.col("n_t").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        (F.col(f"{good}_s") - F.col(f"{good}_t")).alias("good_lost"), (F.col(f"{bad}_s") - F.col(f"{bad}_t")).alias("toxic_lost"), "shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all 120 orders.

    A null text is empty (it fails A only, and E behind a smaller id's empty text), a null lang is the part "". A document has a label if any of
    its rows in labels says 1; a row without a doc_id has none. Only the columns read here matter, so that others may have any name. Without
    documents there are no parts, and so no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    told = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged(docs)
    have = rows.where("doc_id IS NOT NULL").join(told.hint("merge"), "doc_id", "left").unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    return filter_audit(have.select("part", "failed", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), FILTERS, "good", "toxic")
