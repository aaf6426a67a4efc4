"""Fidelity of a match, suggestions, and the checks before an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.money import round_even


def fidelity(mappings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: score (share of high confidences in %, halves to even), fields, high, review, comment.

    Without groups there is one row also for no mappings, with score 0.
    """
    high, total = F.count_if(F.col("confidence") == "high"), F.count("*")
    out = mappings.groupBy(*(by or [])).agg(total.alias("fields"), high.alias("high"))
    score = F.when(F.col("fields") == 0, 0.0).otherwise(round_even(F.col("high") / F.col("fields") * 100, 1))
    review = F.col("fields") - F.col("high")
    said = F.concat(score.cast("string"), F.lit("% dos campos mapeados com alta confiança. "), review.cast("string"), F.lit(" campos requerem revisão."))
    comment = F.when(F.col("fields") == 0, "Nenhum campo mapeado.").otherwise(said)
    return out.withColumns({"score": score, "review": review, "comment": comment})


def suggestions(mappings: DataFrame) -> DataFrame:
    """A warning for each mapping of low confidence."""
    low = mappings.where("confidence = 'low'")
    text = F.format_string("Campo '%s' com baixa confiança de mapeamento (raw: %.2f). Verificar manualmente.", F.col("jsonPath"), round_even(F.col("raw_confidence"), 2))
    return low.select("doc_id", "id", "jsonPath", F.lit("warning").alias("type"), text.alias("message"), F.lit("Revisar mapeamento").alias("action"))


CHECKS = ("html", "css", "js", "job", "libraries", "links")


def checklist(html: Column, css: Column, js: Column, job: Column, libraries: Column) -> Column:
    """Checks (name, critical, ok): four critical ones and two warnings."""
    some = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""
    states = [some(html), some(css), some(js), some(job), F.size(libraries) > 0, F.contains(html, F.lit("./js/"))]
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k < 4).alias("critical"), F.coalesce(ok, F.lit(False)).alias("ok")) for k, (n, ok) in enumerate(zip(CHECKS, states, strict=True))])


def downloadable(checks: Column) -> Column:
    return F.forall(checks, lambda c: ~c["critical"] | c["ok"])


def result_status(status: Column) -> Column:
    """The answer's code for a job's status: 404 unknown, 409 unfinished, 422 failed, 200 done."""
    return F.when(status.isNull(), 404).when(status.isin("pending", "running"), 409).when(status == "error", 422).otherwise(200)


def result_payload(df: DataFrame, names: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """For each output, the first of the candidate columns that isn't null, else the default."""
    have = set(df.columns)
    return df.select("*", *[F.coalesce(*[F.col(c) for c in cols if c in have], default).alias(out) for out, (cols, default) in names.items()])
