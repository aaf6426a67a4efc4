"""Which of a document's patterns its texts hold: one automaton for the patterns, one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 100_000


def _automaton(patterns: dict[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, order in patterns.items():
        if pattern:
            a.add_word(pattern, (order, pattern))
    if len(a):
        a.make_automaton()
    return a


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by document and part, patterns before texts: what is held is the patterns of one document and one batch."""
    now, patterns, automaton = None, {}, None
    for batch in batches:
        place, order, text, row = (batch.column(c).to_pylist() for c in ("place", "ord", "text", "row"))
        rows, found = [], []
        for k, o, t, r in zip(place, order, text, row, strict=True):
            if k != now:
                now, patterns, automaton = k, {}, None
            if o is not None:
                patterns[t] = min(o, patterns.get(t, o))
                continue
            if automaton is None:
                automaton = _automaton(patterns)
            best = min((x for _, x in automaton.iter(t)), default=None) if len(automaton) else None
            if "" in patterns:
                best = min(best or (patterns[""], ""), (patterns[""], ""))
            if best is not None:
                rows.append(r)
                found.append(best[1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], ["row", "pattern"])


def first_inside(texts: DataFrame, patterns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(row, pattern): of the patterns that a text holds, the one of the least ord; texts without any have no row.

    texts: doc_id, row, text; patterns: doc_id, ord, path. A document with more than part_rows texts is cut into parts, each of which gets its patterns. Null
    texts and patterns hold nothing and are held by nothing; the empty pattern is part of every text.
    """
    parts = texts.groupBy("doc_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    a = texts.where("text IS NOT NULL").join(parts, "doc_id").select("doc_id", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("long").alias("ord"), "text", F.col("row").cast("long").alias("row"))
    b = patterns.where("path IS NOT NULL").join(parts, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("path").alias("text"), F.lit(None).cast("long").alias("row"))
    rows = a.unionByName(b).withColumn("place", F.concat_ws("|", "part", F.col("doc_id").cast("string")))
    return rows.repartition("place").sortWithinPartitions("place", F.asc_nulls_last("ord")).select("place", "ord", "text", "row").mapInArrow(_scanned, "row long, pattern string")
