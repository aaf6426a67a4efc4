"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the
next one. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import saved
from lumenfold.llm.bpe import encode
from lumenfold.llm.decontaminate import with_leaks
from lumenfold.llm.language_id import UNKNOWN, Filters, held_out, learn, predict
from lumenfold.llm.near_dup import near_duplicates
from lumenfold.llm.substring_dedup import without_repeats
from lumenfold.operators.report import numbered

#: The share of a language's documents that may lie under what counts as its least.
LOSS = 1e-4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; null texts and those without letters go."""
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    said = predict(docs, filters)
    limit = F.lit(0.0)
    for name, score in least_scores(docs, filters).items():
        limit = F.when(F.col("lang_pred") == name, F.lit(score)).otherwise(limit)
    return said.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= limit)).select(*docs.columns)


def least_scores(docs: DataFrame, filters: Filters | None, loss: float = LOSS) -> dict[str, float]:
    """The least score of each language: midway between what its own documents reach and what a text of another language has in it, by all
    labelled documents that are held out.

    Its own, that is, those that are labelled and found to be of it, reach the score that all but a share `loss` of them have (of fewer than 1 / loss: the
    least). A text of another language has the median of those that are found to be of others, 0 without any. So the least score stays well under
    what a document of the language has had, and over what most texts of a language that nothing is known of would have. Wrong labels count on neither side.
    """
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    if filters is None:
        return {}
    each = predict(rows, filters, shares=True).where(F.col("lang_pred") != UNKNOWN).select("lang", "lang_pred", F.posexplode("shares").alias("k", "share"))
    found_as = F.array(*map(F.lit, filters.languages))[F.col("k")] == F.col("lang_pred")
    own, others = found_as & (F.col("lang") == F.col("lang_pred")), ~found_as
    at = lambda test, p: F.percentile_approx(F.when(test, F.col("share")), F.lit(p), F.lit(100_000))
    found = each.groupBy("k").agg(at(own, loss).alias("own"), at(others, 0.5).alias("others")).collect()
    return {filters.languages[r.k]: min(r.own, (r.own + (r.others or 0.0)) / 2) for r in found if r.own is not None}


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (80 % of 5-word shingles).

    Of rows that repeat an id and its text, one stays; an id's rows with different texts are documents of their own. Rows without an id all stay.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = saved(near_duplicates(docs, k=5, num=80, den=100), "near-copies")
        # The copies grow with the input, so they are never broadcast.
        return docs.join(found.where("not kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    once = docs.where("doc_id is not null").groupBy("doc_id", digest).agg(F.min(F.struct(*docs.columns)).alias("doc"))
    rows = saved(numbered(once, ["doc_id", "digest"], name="row").select("row", "doc"), "rows-by-id")
    found = saved(near_duplicates(rows.select("row", "doc.text"), id="row", k=5, num=80, den=100), "near-copies")
    return rows.join(found.where("not kept").select("row"), "row", "left_anti").select("doc.*").union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 50 words that occur earlier; n_chars is counted again. Texts without any stay as they are."""
    rows = docs.withColumn("_lf_null", F.col("text").isNull())
    out = without_repeats(rows, window=50)
    text = F.when(~F.col("_lf_null"), F.col("kept_text"))
    size = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("text", text).withColumn("n_chars", size).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, their number, and whether they decode to the text."""
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    coded = encode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id", "lang", "source", "text_sha256"], decode=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text_sha256", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dup", near_dup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]
#: SQL has no MinHash families, templates or byte pairs; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
