"""Classifications and rules, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.nested import string_to_bool, useful_value
from lumenfold.functions.text import normalize_text

UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
# Schema types behind each kind of field.
DATE_TYPES = ["date", "datetime", "time"]
CURRENCY_TYPES = ["decimal", "float", "double", "integer", "int", "long", "currency"]
LIST_TYPES = ["list", "array"]


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def match_status(c: Column, missing_in_data: Column, missing_in_schema: Column) -> Column:
    return F.when(missing_in_schema, "optional").when(missing_in_data, "not_found").when(c >= 0.8, "ok").when(c >= 0.5, "ambiguous").otherwise("not_found")


def field_type(c: Column, strip_prefix: bool = False) -> Column:
    """date, currency, list or text. Prefixed names such as xs:date are text, unless strip_prefix."""
    t = F.lower(F.regexp_replace(c, "^[^:]*:", "") if strip_prefix else c)
    return F.when(t.isin(DATE_TYPES), "date").when(t.isin(CURRENCY_TYPES), "currency").when(t.isin(LIST_TYPES), "list").otherwise("text")


def override(edit: Column, generated: Column) -> Column:
    return F.coalesce(F.nullif(edit, F.lit("")), generated)


def mapping_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "confidence": F.coalesce("confidence", F.lit("medium")),
        "status": F.coalesce("status", F.lit("ambiguous")),
        "type": F.coalesce("type", F.lit("text")),
        "candidates": F.coalesce("candidates", F.array().cast("array<string>")),
    })


def unresolved(status: Column, manual: Column | None = None) -> Column:
    """status not_found; with manual, only if it wasn't edited."""
    return (status == "not_found") & (~manual if manual is not None else F.lit(True))


def fidelity_tone(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def fidelity_low(score: Column) -> Column:
    return score < 70


def route_gates(extraction: Column, mapping_confirmed: Column, layout_confirmed: Column, html: Column) -> Column:
    return F.struct(extraction.isNotNull().alias("fields"), mapping_confirmed.alias("layout"), layout_confirmed.alias("generation"), html.isNotNull().alias("export"))


# What is said of files.
EMPTY_PDF, BAD_SCHEMA, BAD_DATA = "PDF vazio.", "Arquivo XSD invalido.", "Arquivo de dados deve ser JSON ou XML."


def file_divergences(pdf_size: Column, xsd_name: Column, data_name: Column) -> Column:
    """What is wrong with a set of files, as a list of texts."""
    return F.array_compact(F.array(F.when(pdf_size == 0, EMPTY_PDF), F.when(~F.lower(xsd_name).endswith(".xsd"), BAD_SCHEMA), F.when(~F.lower(data_name).rlike(r"\.(json|xml)$"), BAD_DATA)))


def number_of(c: Column) -> Column:
    """As a unary plus: '' and null give 0, other text that is no number NaN."""
    s = F.trim(c.cast("string"))
    return F.when(s.isNull() | (s == ""), 0.0).otherwise(F.coalesce(s.try_cast("double"), F.lit(float("nan"))))


def names_differ(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) != F.lower(F.trim(b))


def payment_table_visible(bank_fields: list[Column], basic_fields: list[Column]) -> Column:
    full, some = (reduce(op, map(useful_value, cols)) for op, cols in ((lambda a, b: a & b, bank_fields), (lambda a, b: a | b, basic_fields)))
    return ~full & some


# The providers whose cards are shown.
CARD_PROVIDERS = ("9999998", "75440039")


def assistance_card(flag: Column, providers: Column, codes: tuple[str, str] = CARD_PROVIDERS) -> Column:
    """(shown, first, second): a flag, and which of two codes is in the array of providers."""
    known = F.transform(providers, lambda x: F.trim(x.cast("string")))
    on = string_to_bool(flag)
    hits = [F.coalesce(on & F.array_contains(known, c), F.lit(False)) for c in codes]
    return F.struct((hits[0] | hits[1]).alias("shown"), hits[0].alias("first"), hits[1].alias("second"))


def token_flags(kind: Column) -> Column:
    return F.struct(*[(F.lower(kind) == k).alias(k) for k in ("email", "sms", "whatsapp")])


def is_renewal(sequence: Column) -> Column:
    """Not a loose zero: '', '0' and null are none, text that is no number is one."""
    s = F.trim(sequence.cast("string"))
    return ~(s.isNull() | (s == "") | F.coalesce(s.try_cast("double") == 0, F.lit(False)))


def is_saf(name: Column, whole_word: bool = False) -> Column:
    return F.lower(name).rlike(r"\bsaf\b") if whole_word else F.contains(normalize_text(name), F.lit("SAF"))


# The siglas of the second event rule, the one that only the first version has, and the description that counts.
SPECIAL = ["ITA", "ITD", "IH", "IHA"]
SPECIAL_V1 = "ID"
INCAPACITY = "INCAPACIDADE FÍSICA TOTAL E TEMPORÁRIA"


def event_rules(sigla: Column, i_coverages: Column, ia_coverages: Column, version: int = 2) -> Column:
    """(default, i, ia) by the sigla, the descriptions of the I coverages and the array of IA coverages.

    Version 1 has one special sigla more and no rule by description.
    """
    s = F.coalesce(sigla, F.lit(""))
    special = s.isin(SPECIAL + [SPECIAL_V1] * (version == 1))
    count = F.coalesce(F.size(ia_coverages), F.lit(0))
    default, i = ~(special | (s == "IA")) | ((s == "IA") & (count <= 0)), special
    if version == 2:
        some = lambda test: F.coalesce(F.exists(i_coverages, test), F.lit(False))
        default, i = default | some(lambda d: d == INCAPACITY), i & some(lambda d: d != INCAPACITY)
    return F.struct(default.alias("default"), i.alias("i"), ((s == "IA") & (count > 0)).alias("ia"))


def has_waiting_period(rules: Column) -> Column:
    """Whether any struct of the list has any non-null field of progressive, defined, causes, suicide."""
    return F.exists(rules, lambda r: r["progressive"].isNotNull() | r["defined"].isNotNull() | r["causes"].isNotNull() | r["suicide"].isNotNull())


def participant(beneficiary: Column, requester: Column, name: str = "name") -> Column:
    """The beneficiary struct, unless its name is blank or 'beneficiario indefinido', else the requester's."""
    n = F.lower(F.trim(beneficiary[name]))
    return F.when(n.isNotNull() & ~n.isin("", "beneficiario indefinido"), beneficiary).otherwise(requester)


def color_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def library_versions(selected: Column, active: Column) -> Column:
    """Maps of library to version: the selected one wins."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(active, lambda k, v: ~F.coalesce(F.map_contains_key(selected, k), F.lit(False)))), F.coalesce(F.map_entries(selected), F.array().cast("array<struct<key:string,value:string>>"))))


def valid_job_id(c: Column) -> Column:
    return F.lower(c).rlike(UUID4)


def all_filled(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, map(useful_value, cols))


def all_blank(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (~useful_value(c) for c in cols))


def any_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, map(useful_value, cols))


def partner_theme(color: Column, banner: Column, logo: Column) -> Column:
    return all_filled([color, banner, logo])
