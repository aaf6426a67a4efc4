"""Waiting periods of coverages as texts.

details: an array of structs (name, defined: array of (amount, unit), causes: array of (cause, amount, unit),
progressive: array of (start, end, unit, percent)). Units are meses, parcelas and dias in any case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.nested import useful_value
from lumenfold.functions.predicates import is_saf
from lumenfold.functions.text import normalize_text, progressive_period, sentence

# The rules in order, their texts, and the clause that ends a list of texts.
BRANCHES = ["saf_months", "months", "instalments", "days", "causes"]
TEXTS = {
    "saf_months": "Para o plano/cobertura {name} haverá carência de {amount} mês(es) para segurados a partir de 65 anos ou quando não houver o preenchimento de DPS (Declaração Pessoal de Saúde). Esta carência é aplicável somente ao titular do seguro.",
    "months": "Para o(s) plano(s)/cobertura(s) {name} haverá carência de {amount} mes(es).",
    "instalments": "Para o(s) plano(s)/cobertura(s) {name}, quando não preenchida DPS, haverá carência de {amount} parcela(s).",
    "days": "Para o(s) plano(s)/cobertura(s) {name}, haverá carência de {amount} dia(s) para doenças específicas assim caracterizadas nas condições gerais/cláusulas especiais.",
    "causes": "Para o(s) plano(s)/cobertura(s) {name}, haverá carência de {amount} {unit} para a seguinte causa: {cause}.",
    "MESES": "Para o(s) plano(s) {name} quando não preenchida DPS, será adotado um período de carência em que o(s) beneficiário(s) fazem jus a um percentual do capital segurado, da seguinte forma:",
    "PARCELAS": "Para a cobertura {name}, quando não preenchida DPS, será adotado um período de carência progressiva por parcelas, na qual o(s) beneficiário(s) fazem jus a um percentual do capital segurado, da seguinte forma:",
}
SUICIDE = "Para os casos de suicídio ou sua tentativa, haverá carência de 24 meses nos termos do Art. 120 - Lei 15.040."
INDEXER = "O seu seguro será atualizado pelo {indexer}. Para mais informações, consulte as condições gerais."
DETAILS = (
    "array<struct<name:string,defined:array<struct<amount:int,unit:string>>,causes:array<struct<cause:string,amount:int,unit:string>>,"
    "progressive:array<struct<start:int,end:int,unit:string,percent:double>>>>"
)


def _filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its marks; null is empty."""
    out = F.lit(template)
    for mark, c in values.items():
        out = F.replace(out, F.lit("{" + mark + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def waiting_rules(df: DataFrame, keys: list[str], details: str = "details", exclude_saf: bool = True, whole_word: bool = False) -> DataFrame:
    """keys, branch, detail_idx, rule_idx, text: all defined waiting periods and causes in one pass, to be ordered by these.

    Months of an SAF coverage are a branch of their own; exclude_saf keeps them out of the months, else they are in both.
    """
    rows = df.select(*keys, F.posexplode(details).alias("detail_idx", "d"))
    defined = F.transform(F.coalesce("d.defined", F.array().cast("array<struct<amount:int,unit:string>>")), lambda x: F.struct(F.lit(None).cast("string").alias("cause"), x["amount"].alias("amount"), x["unit"].alias("unit"), F.lit(False).alias("by_cause")))
    causes = F.transform(F.coalesce("d.causes", F.array().cast("array<struct<cause:string,amount:int,unit:string>>")), lambda x: F.struct(x["cause"].alias("cause"), x["amount"].alias("amount"), x["unit"].alias("unit"), F.lit(True).alias("by_cause")))
    each = rows.select(*keys, "detail_idx", F.col("d.name").alias("name"), F.posexplode(F.concat(defined, causes)).alias("rule_idx", "r"))
    saf = F.coalesce(is_saf(F.col("name"), whole_word), F.lit(False))
    unit = F.lower("r.unit")
    plain = ~F.col("r.by_cause")
    hits = [plain & (unit == "meses") & saf, plain & (unit == "meses") & (~saf if exclude_saf else F.lit(True)), plain & (unit == "parcelas"), plain & (unit == "dias"), ~plain & useful_value(F.col("r.cause"))]
    chosen = each.withColumn("branch", F.explode(F.array_compact(F.array(*[F.when(h, k) for k, h in enumerate(hits)]))))
    values = {"name": F.col("name"), "amount": F.col("r.amount"), "unit": unit, "cause": F.col("r.cause")}
    text = reduce(lambda out, k: F.when(F.col("branch") == k, _filled(TEXTS[BRANCHES[k]], **values)).otherwise(out), range(len(BRANCHES)), F.lit(None).cast("string"))
    return chosen.select(*keys, "branch", "detail_idx", "rule_idx", text.alias("text"))


def progressive_rules(df: DataFrame, keys: list[str], details: str = "details") -> DataFrame:
    """keys, detail_idx, rule_idx, unit, text, period, percent: the tables of progressive waiting periods in months and instalments.

    Rows without a start, an end or a percentage are left out; coverages without a name have none in months.
    """
    rows = df.select(*keys, F.posexplode(details).alias("detail_idx", "d"))
    each = rows.select(*keys, "detail_idx", F.trim("d.name").alias("name"), F.posexplode("d.progressive").alias("rule_idx", "r"))
    unit = normalize_text(F.col("r.unit"))
    complete = F.col("r.start").isNotNull() & F.col("r.end").isNotNull() & F.col("r.percent").isNotNull()
    kept = each.where(complete & ((unit == "PARCELAS") | ((unit == "MESES") & useful_value(F.col("name")))))
    text = F.when(unit == "MESES", _filled(TEXTS["MESES"], name=F.col("name"))).otherwise(_filled(TEXTS["PARCELAS"], name=F.col("name")))
    # As a number prints: 50.0 as 50.
    number = F.regexp_replace(F.col("r.percent").cast("string"), r"\.0$", "")
    percent = F.concat(F.replace(number, F.lit("."), F.lit(",")), F.lit("%"))
    return kept.select(*keys, "detail_idx", "rule_idx", unit.alias("unit"), text.alias("text"), progressive_period(F.col("r.start"), F.col("r.end"), F.col("r.unit")).alias("period"), percent.alias("percent"))


def waiting_texts(parts: list[Column], last: Column | None = None) -> Column:
    """Arrays of texts one after the other, null ones as empty, and a last text: the constant clause, or read from the data (null: none)."""
    empty = F.array().cast("array<string>")
    return F.array_compact(F.concat(*[F.coalesce(p, empty) for p in parts], F.array(F.lit(SUICIDE) if last is None else last)))


def account_label(agency: Column, account: Column) -> Column:
    return F.concat(agency.cast("string"), F.lit(" - "), account.cast("string"))


def indexer_text(indexer: Column) -> Column:
    """A sentence about the index that values follow; '' for none."""
    return F.when(F.coalesce(indexer, F.lit("")) != "", sentence(INDEXER, indexer=indexer)).otherwise("")
