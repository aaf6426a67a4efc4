"""Fields of a schema, blocks of a page and keys of a data file matched by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.money import normalize_br, round_even
from lumenfold.functions.predicates import confidence_level, field_type, match_status
from lumenfold.functions.text import levenshtein_similarity, normalize_name
from lumenfold.operators.similar import alike
from lumenfold.operators.substrings import first_inside
from lumenfold.operators.written import saved


def name_confidence(text: Column, name: Column) -> Column:
    """Of two normalised names: 1 if equal, else their similarity, but 0.75 at least if one holds the other."""
    similar = levenshtein_similarity(text, name)
    return F.when(text == name, 1.0).when((F.contains(text, name) | F.contains(name, text)) & (similar < 0.75), 0.75).otherwise(similar)


def best_blocks(fields: DataFrame, blocks: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, field_idx, confidence, block_idx) of each field's best block; fields without one have no row.

    fields: doc_id, field_idx, norm. blocks: doc_id, block_idx, norm. The first of equally good blocks wins; only confidences above 0
    count. Equal texts of a document are compared once, as their first block, and equal names once. What has an equal block is settled by a hash join. Of the
    other names, those with a text of a similarity of at least `least` (0.75 at most, so that what holds another is among these) are settled by the texts that indexes
    find (operators.similar). Only what is left meets the document's other texts, as far as the lengths allow more than its best so far.
    """
    texts = blocks.groupBy("doc_id", "norm").agg(F.min("block_idx").alias("block_idx"))
    exact = fields.join(texts, ["doc_id", "norm"]).select("doc_id", "field_idx", F.lit(1.0).alias("confidence"), "block_idx")
    rest = fields.join(texts.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti")
    # A name that several fields share is compared once.
    names = saved(rest.select("doc_id", "norm").distinct(), "names")
    texts = saved(texts, "texts")
    told = texts.withColumnRenamed("norm", "text")
    best = lambda pairs: pairs.where("confidence > 0").groupBy("doc_id", "norm").agg(F.max(F.struct("confidence", (-F.col("block_idx")).alias("first"))).alias("best"))
    scored = lambda pairs: pairs.select("doc_id", "norm", "block_idx", name_confidence(F.col("text"), F.col("norm")).alias("confidence"))
    found = saved(best(scored(alike(names, texts.select("doc_id", "norm"), least).join(told, ["doc_id", "text"]))), "found")
    settled = found.where(F.col("best.confidence") >= least)
    open_ = names.join(settled.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").join(found.select("doc_id", "norm", F.col("best.confidence").alias("so_far")), ["doc_id", "norm"], "left")
    a, b = F.length("norm"), F.length("text")
    others = open_.join(told, "doc_id").where(F.least(a, b) / F.greatest(a, b) >= F.coalesce("so_far", F.lit(0.0)))
    every = settled.unionByName(best(scored(others)))
    near = rest.join(every, ["doc_id", "norm"]).select("doc_id", "field_idx", "best.confidence", (-F.col("best.first")).alias("block_idx"))
    return exact.unionByName(near)


def candidates(fields: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, field_idx, candidates): the texts of each field's k best blocks, best first."""
    pairs = fields.alias("f").join(blocks.alias("b"), "doc_id").select("doc_id", "f.field_idx", "b.block_idx", "b.text", name_confidence(F.col("b.norm"), F.col("f.norm")).alias("c")).where("c > 0")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc_id", "field_idx").orderBy(F.desc("c"), "block_idx"))
    top = pairs.withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy("doc_id", "field_idx").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("x")).select("doc_id", "field_idx", F.col("x.text").alias("candidates"))


def match_fields(blocks: DataFrame, schema: DataFrame, data: DataFrame, match_on: str = "path", strip_prefix: bool = False, normalize=normalize_name) -> DataFrame:
    """field_mappings: each schema field with its best block and data value, then the data keys that the schema lacks.

    blocks: doc_id, block_idx, text, x, y, width, height, page. schema: doc_id, field_idx, name, type. data: doc_id, key_idx,
    key, value. Data keys are compared whole; match_on="leaf" takes what follows the last dot. Of equal keys the last one's value
    counts. Without any data for a document nothing is missing from it.
    """
    own = blocks.where(F.trim("text") != "").withColumn("norm", normalize(F.col("text")))
    fields = schema.withColumn("norm", normalize(F.col("name")))
    key = F.regexp_extract("key", r"[^.]*$", 0) if match_on == "leaf" else F.col("key")
    keys = data.withColumn("norm", normalize(key))
    best = best_blocks(fields.select("doc_id", "field_idx", "norm"), own.select("doc_id", "block_idx", "norm"))
    place = own.select("doc_id", "block_idx", "text", F.col("page").alias("pageRef"), F.struct("x", "y", "width", "height").alias("boundingBox"))
    found = best.join(place, ["doc_id", "block_idx"]).drop("block_idx")
    values = keys.groupBy("doc_id", "norm").agg(F.max_by("value", "key_idx").alias("data_value"), F.lit(True).alias("in_data"))
    with_data = data.select("doc_id").distinct().withColumn("has_data", F.lit(True))
    joined = fields.join(found, ["doc_id", "field_idx"], "left").join(values, ["doc_id", "norm"], "left").join(with_data, "doc_id", "left")
    confidence = F.coalesce("confidence", F.lit(0.0))
    missing = F.coalesce("has_data", F.lit(False)) & F.col("in_data").isNull()
    text = F.coalesce("text", F.lit(""))
    mapped = joined.select(
        "doc_id", F.lit(0).alias("part"), F.col("field_idx").cast("long").alias("ord"), text.alias("pdfText"), F.col("name").alias("jsonPath"),
        field_type(F.col("type"), strip_prefix).alias("type"), confidence_level(confidence).alias("confidence"),
        match_status(confidence, missing, F.lit(False)).alias("status"), F.lit(False).alias("isManual"), "pageRef", "boundingBox",
        round_even(confidence, 4).alias("raw_confidence"), F.coalesce("data_value", F.lit("")).alias("data_value"),
        F.col("type").alias("xsd_type"), F.when(text != "", normalize_br(text)).otherwise("").alias("normalized_value"),
    )
    extra = keys.join(fields.select("doc_id", "norm").distinct(), ["doc_id", "norm"], "left_anti").select(
        "doc_id", F.lit(1).alias("part"), F.col("key_idx").cast("long").alias("ord"), F.lit("").alias("pdfText"), F.col("key").alias("jsonPath"),
        F.lit("text").alias("type"), F.lit("low").alias("confidence"), F.lit("optional").alias("status"), F.lit(False).alias("isManual"),
        F.lit(0.0).alias("raw_confidence"), F.col("value").alias("data_value"), F.lit("string").alias("xsd_type"), F.lit("").alias("normalized_value"),
    )
    out = mapped.unionByName(extra, allowMissingColumns=True)
    return out.withColumn("id", F.sha2(F.concat_ws("|", "doc_id", "part", "ord"), 256))


def cross_validate(schema: DataFrame, data: DataFrame, normalize=normalize_name) -> DataFrame:
    """(doc_id, name, problem): fields of the schema that the data lacks, and keys that the schema lacks."""
    s = schema.select("doc_id", "name", normalize(F.col("name")).alias("norm"))
    d = data.select("doc_id", F.col("key").alias("name"), normalize(F.col("key")).alias("norm"))
    lacking = s.join(d.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").select("doc_id", "name", F.lit("missing_in_data").alias("problem"))
    return lacking.unionByName(d.join(s.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").select("doc_id", "name", F.lit("missing_in_schema").alias("problem")))


def edit_mappings(mappings: DataFrame, edits: DataFrame) -> DataFrame:
    """mappings with the paths of edits (id, path), which make them manual and ok."""
    e = edits.select(F.col("id").alias("_lf_edit"), F.col("path").alias("_lf_path"))
    hit = F.col("_lf_edit").isNotNull()
    out = mappings.join(e, mappings["id"] == e["_lf_edit"], "left")
    return out.withColumns({"jsonPath": F.coalesce("_lf_path", "jsonPath"), "isManual": hit | F.col("isManual"), "status": F.when(hit, "ok").otherwise(F.col("status"))}).drop("_lf_edit", "_lf_path")


def fields_of_blocks(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """blocks with the field each stands for: the last of equal path, else the first whose path is part of the text, else null.

    fields: doc_id, ord, path. An empty path is part of every text. A document's paths are one automaton, which scans each text once.
    """
    text = F.trim("text")
    equal = fields.groupBy("doc_id", F.col("path").alias("_lf_text")).agg(F.lit(True).alias("_lf_equal"))
    b = saved(blocks.withColumn("_lf_text", text).join(equal, ["doc_id", "_lf_text"], "left").withColumn("_lf_row", F.monotonically_increasing_id()), "blocks")
    inside = first_inside(b.where("_lf_equal is null").select("doc_id", F.col("_lf_row").alias("row"), F.col("_lf_text").alias("text")), fields)
    found = b.join(inside.withColumnsRenamed({"row": "_lf_row", "pattern": "_lf_inside"}), "_lf_row", "left")
    return found.withColumn("field", F.when(F.col("_lf_equal"), F.col("_lf_text")).otherwise(F.col("_lf_inside"))).drop("_lf_text", "_lf_equal", "_lf_inside", "_lf_row")
