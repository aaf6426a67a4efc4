"""Pages of texts of any length, whose lines are rows: the next break behind each line by prefix sums, the breaks by pointer doubling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold.operators.written import drop, saved

BLOCK = 4096
FOLDED = 16384
SUM = "decimal(38,9)"


def running(rows: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows (doc_id, i, ...) with the sum of value up to and with each i of its document, by sums of blocks of i, so that a long document isn't one task's."""
    cut = rows.withColumn("_lf_b", F.floor(F.col("i") / block)).withColumn("_lf_v", value)
    blocks = cut.groupBy("doc_id", "_lf_b").agg(F.sum("_lf_v").alias("_lf_s"))
    before = F.sum("_lf_s").over(Window.partitionBy("doc_id").orderBy("_lf_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("doc_id", "_lf_b", F.coalesce(before, F.lit(0)).alias("_lf_s"))
    within = F.sum("_lf_v").over(Window.partitionBy("doc_id", "_lf_b").orderBy("i"))
    return cut.join(blocks, ["doc_id", "_lf_b"]).withColumn(name, F.col("_lf_s") + within).drop("_lf_b", "_lf_v", "_lf_s")


def _next(rows: DataFrame, limit: float, strict: bool, most: int | None, span: float) -> DataFrame:
    """(doc_id, i, j): where the page that begins at i ends, that is, the first j behind i whose sum since i reaches the limit (strict: exceeds it).

    Each line looks for limit + the sum before it among the sums; both are cut into spans of them, and what finds none in its span takes the
    first line of the next.
    """
    width = F.lit(span).cast(SUM)
    points = rows.select("doc_id", F.col("upto").alias("v"), F.lit(None).cast("long").alias("ask"), F.col("i").alias("point"))
    asks = rows.select("doc_id", (F.col("upto") - F.col("size") + F.lit(limit).cast(SUM)).alias("v"), F.col("i").alias("ask"), F.lit(None).cast("long").alias("point"))
    both = points.unionByName(asks).withColumn("at", F.floor(F.col("v") / width))
    # From the greatest sum down, as frames that run on to the end are summed anew for each row. Of equal sums, a line that only needs to be reached comes before its asker, one that must be exceeded behind.
    order = Window.partitionBy("doc_id", "at").orderBy(F.col("v").desc(), F.col("ask").isNotNull() if not strict else F.col("ask").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("j", F.min("point").over(order)).where("ask IS NOT NULL").select("doc_id", "at", F.col("ask").alias("i"), "j")
    firsts = points.groupBy("doc_id", F.floor(F.col("v") / width).alias("at")).agg(F.min("point").alias("first"))
    ats = firsts.select("doc_id", "at", "first").unionByName(found.where("j IS NULL").select("doc_id", "at").distinct().withColumn("first", F.lit(None).cast("long")))
    ats = ats.groupBy("doc_id", "at").agg(F.min("first").alias("first"))
    later = ats.select("doc_id", "at", F.min("first").over(Window.partitionBy("doc_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    j = F.greatest(F.coalesce("j", "later"), F.col("i") + 1)
    told = found.join(later, ["doc_id", "at"], "left").select("doc_id", "i", F.when(F.coalesce("j", "later").isNotNull(), j).alias("j"))
    return told.withColumn("j", F.least("j", F.col("i") + most)) if most else told


def pages(rows: DataFrame, limit: float, strict: bool = False, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows (doc_id, i from 0, size) with the page of each line, from 0.

    A page ends before the line with which its sum of sizes reaches the limit (strict: exceeds it), or that would be one more than `most`; a line that fits no page
    gets one of its own. The breaks are what is reached from line 0 by steps to the next break; sets of breaks double with each
    round, as the steps do. Sizes are summed as decimals of nine places; null counts as 0.
    """
    sized = rows.select("doc_id", F.col("i").cast("long").alias("i"), F.coalesce(F.col("size"), F.lit(0)).cast(SUM).alias("size"))
    sized = saved(running(sized, F.col("size"), "upto", block), "lines")
    steps = _next(sized, limit, strict, most, max(64 * limit, 1.0)).where("j IS NOT NULL")
    last = sized.groupBy("doc_id").agg(F.max("i").alias("last"))
    steps = saved(steps.join(last, "doc_id").where("j <= last").drop("last"), "steps")
    reached, n = saved(sized.where("i = 0").select("doc_id", "i"), "breaks"), -1
    while (now := reached.count()) != n:
        n = now
        more = reached.join(steps, ["doc_id", "i"]).select("doc_id", F.col("j").alias("i"))
        reached, before = saved(reached.unionByName(more).distinct(), "breaks"), reached
        drop(before)
        on = steps.select("doc_id", F.col("i").alias("j"), F.col("j").alias("k"))
        steps, before = saved(steps.join(on, ["doc_id", "j"]).select("doc_id", "i", F.col("k").alias("j")), "steps"), steps
        drop(before)
    flagged = sized.select("doc_id", "i").join(reached.withColumn("_lf_break", F.lit(1)), ["doc_id", "i"], "left")
    return running(flagged, F.coalesce("_lf_break", F.lit(0)), "page", block).select("doc_id", "i", (F.col("page") - 1).cast("int").alias("page"))


def packed_lines(rows: DataFrame, capacity: int = 14, per_line: int = 90, most: int = 10) -> DataFrame:
    """report.packed_pages for lines as rows (doc_id, i, size in characters)."""
    return pages(rows, float(capacity * per_line), False, most)


def stacked_lines(rows: DataFrame, capacity: float, header: float = 0.0) -> DataFrame:
    """report.height_pages for lines as rows (doc_id, i, size in units of height)."""
    return pages(rows, capacity - header, True)


def _fold(separator: str, limit: int, most: int):
    def fold(batches):
        """(doc_id, page, lines, letters) of whole texts: in round k the k-th pages of all texts of a batch, by prefix sums over all their lines."""
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lines = pc.split_pattern(batch["text"], separator)
            ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False), dtype="int64")
            upto = np.concatenate([[0], np.cumsum(pc.utf8_length(pc.list_flatten(lines)).to_numpy(zero_copy_only=False), dtype="int64")])
            doc, at, page = np.arange(len(ends)), np.concatenate([[0], ends])[:-1], 0
            while len(doc):
                full = np.searchsorted(upto, upto[at] + limit) - 1  # the line with which the page's letters reach the limit
                stop = np.minimum(np.clip(full, at + 1, at + most), ends[doc])
                columns = [np.full(len(doc), page, "int32"), stop - at, upto[stop] - upto[at]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc)), *map(pa.array, columns)], ["doc_id", "page", "lines", "letters"])
                more = stop < ends[doc]
                doc, at, page = doc[more], stop[more], page + 1

    return fold


def packed_texts(texts: DataFrame, separator: str = " ", capacity: int = 14, per_line: int = 90, most: int = 10, block: int = FOLDED) -> DataFrame:
    """(doc_id, page, lines, letters) of texts (doc_id, text) whose lines are what the separator, one character, sets apart.

    Texts of up to `block` lines are folded as they are read. Longer ones have their lines as rows and go through packed_lines.
    """
    texts = texts.select("doc_id", "text").where("doc_id IS NOT NULL")
    short = F.length("text") - F.length(F.replace("text", F.lit(separator), F.lit(""))) < block
    kind = StructType([texts.schema["doc_id"], *StructType.fromDDL("page int, lines long, letters long")])
    folded = texts.where(short).mapInArrow(_fold(separator, capacity * per_line, most), kind)
    rows = texts.where(~short).select("doc_id", F.posexplode(F.split("text", f"[{separator}]")).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("i"), F.length("line").cast("long").alias("size"))
    made = packed_lines(rows, capacity, per_line, most).join(rows, ["doc_id", "i"])
    return folded.unionByName(made.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum("size").alias("letters")))
