"""String functions, Column to Column."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters whose compatibility decomposition is a base letter and marks, up to U+024F and without those of several letters.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:]))
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; other characters stay."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), "[̀-ͯ]", "")


def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


# What is left of each character behind ASCII, where that is one character, or several.
_FOLDED = {c: f for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if (f := _ascii(c))}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDED.items() if len(f) > 1}


_BEYOND = "[\u00bc-\u00be" + min(c for c in _MORE if c > "\u00be") + "-" + max(_MORE) + "]"


def _unfolded(c: Column) -> Column:
    """ASCII of the compatibility decomposition; only texts with characters that become several are taken apart."""
    pairs = F.expr("map(" + ", ".join(f"'{k}', '" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in _MORE.items()) + ")")
    taken = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    # Everyday texts hold none of these: a range tells so at once, where the list of them is long.
    some = F.when(c.rlike(_BEYOND) & c.rlike("[" + "".join(_MORE) + "]"), taken).otherwise(c)
    return F.regexp_replace(F.translate(some, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]", "")


def normalize_name(c: Column) -> Column:
    """ASCII of the compatibility decomposition, runs of - _ and white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_unfolded(c), r"[-_\s\x1c-\x1f]+", " ")))


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normalize_name_exact(c: Column) -> Column:
    """normalize_name by full compatibility decomposition, in an Arrow UDF."""
    return F.lower(F.trim(F.regexp_replace(_nfkd(c), r"[-_\s\x1c-\x1f]+", " ")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal strings, 0 if one alone is empty."""
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def normalize_text(c: Column) -> Column:
    """Upper case without combining marks; other non-ASCII stays."""
    return F.upper(strip_accents(c))


def sanitize_identifier(c: Column) -> Column:
    """A valid identifier: other characters become _, a leading digit gets one before it, empty becomes _field."""
    plain = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    return F.when(plain == "", "_field").when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_js(c: Column) -> Column:
    return _replaced(c, [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")])


def escape_html(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _mask_cpf(d: Column) -> Column:
    return F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", r"$1.$2.$3-$4")


def cpf_mask(c: Column, variant: str = "strict") -> Column:
    """strict: 11 digits, else ''. left: 10 digits get a 0 in front. right: one 0 behind. pad: filled with 0 behind to 11, digits not cleaned."""
    d = digits(c)
    if variant == "pad":
        return _mask_cpf(F.when(F.length(c) < 11, F.rpad(c, 11, "0")).otherwise(c))
    if variant == "left":
        d = F.when(F.length(d) == 10, F.concat(F.lit("0"), d)).otherwise(d)
    elif variant == "right":
        d = F.when(F.length(d) == 10, F.concat(d, F.lit("0"))).otherwise(d)
    return F.when(F.length(d) == 11, _mask_cpf(d)).otherwise(F.lit("") if variant == "strict" else c)


def cnpj_mask(c: Column, clean: bool = False) -> Column:
    """14 letters or digits as 99.999.999/9999-99, 13 digits with a 0 in front; else unchanged, or without . - / and white space."""
    a = F.regexp_replace(c, r"[.\-/\s]", "")
    a = F.when(a.rlike(r"^[0-9]{13}$"), F.concat(F.lit("0"), a)).otherwise(a)
    masked = F.regexp_replace(a, r"^(.{2})(.{3})(.{3})(.{4})(.{2})$", r"$1.$2.$3/$4-$5")
    return F.when(a.rlike("^[0-9A-Za-z]{14}$"), masked).otherwise(a if clean else c)


def document_type(c: Column) -> Column:
    """CNPJ from 13 letters or digits, CPF from 10, else null."""
    n = F.length(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return F.when(n >= 13, "CNPJ").when(n >= 10, "CPF")


def cpf_or_cnpj_mask(c: Column) -> Column:
    """10 or 11 digits as CPF, 13 or 14 digits or 14 letters and digits as CNPJ, else unchanged."""
    plain = F.regexp_replace(c, r"[.\-/\s]", "")
    return F.when(plain.rlike("^[0-9]{10,11}$"), cpf_mask(plain, "left")).otherwise(cnpj_mask(c))


def cep_mask(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 8, F.regexp_replace(d, r"^(\d{5})(\d{3})$", "$1-$2")).otherwise("")


def address(street: Column, number: Column, extra: Column) -> Column:
    """street, number, extra, without what is blank."""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(", "), c)).otherwise("")
    return F.concat(F.coalesce(street, F.lit("")), part(number), part(extra))


def address_parts(street: Column, number: Column, extra: Column, district: Column, city: Column, state: Column, cep: Column) -> Column:
    """A struct of parts with the separators they need; the number and the extra depend on the street, the CEP's comma on the city."""
    street, number, extra, district, city, state, cep = (F.trim(F.coalesce(c, F.lit(""))) for c in (street, number, extra, district, city, state, cep))
    both = (street != "") & (number != "")
    named = F.when(F.contains(F.lower(district), F.lit("bairro")), F.concat(F.lit(", "), district)).otherwise(F.concat(F.lit(", Bairro "), district))
    return F.struct(
        F.when((city != "") & (cep != ""), F.concat(F.lit(", "), cep)).otherwise(cep).alias("cep"),
        F.when(both, F.concat(street, F.lit(", "))).otherwise(street).alias("street"),
        F.when(both & (extra != ""), F.concat(number, F.lit(", "), extra)).when(both, number).otherwise("").alias("number"),
        F.when(district == "", "").otherwise(named).alias("district"),
        city.alias("city"),
        state.alias("state"),
    )


def clean_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit(""))


def clean_trailing_ampersand(c: Column) -> Column:
    """Without an &amp; or .& at the end."""
    return F.regexp_replace(c, r"(&amp;|\.&)\s*$", "")


def split_question(c: Column) -> Column:
    """(question, rest) around the first #; the rest is empty without one."""
    at = F.instr(c, "#")
    return F.struct(F.when(at > 0, F.substring_index(c, "#", 1)).otherwise(c).alias("question"), F.when(at > 0, F.substr(c, at + 1)).otherwise("").alias("rest"))


def first_token(c: Column) -> Column:
    return F.split_part(c, F.lit(" "), F.lit(1))


def or_default(c: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


# The sentences and phrases of the functions below, with {…} for what is put in.
FROM_UNTIL_HOURS, FROM_HOURS, FROM_UNTIL = "{start} 00h \naté {end} 23h59", "{start} 00h", "{start} até {end}"
WAITING = "Para a cobertura {name} haverá carência de {amount} {unit}."
MONTHS_OPEN, MONTHS, INSTALMENTS = "A partir de {start} meses", "De {start} até {end} meses", "De {start} até {end} parcela(s)"


def sentence(template: str, **values: Column) -> Column:
    """A template's text with columns in place of its marks; null if any of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def period_text(start: Column, end: Column, hours: bool = True) -> Column:
    """With hours: 'start 00h \\naté end 23h59', or 'start 00h' alone. Without: 'start até end' if both are there."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    if hours:
        return F.when(has(start) & has(end), F.concat(start, F.lit(" 00h \naté "), end, F.lit(" 23h59"))).when(has(start), F.concat(start, F.lit(" 00h"))).otherwise("")
    return F.when(has(start) & has(end), F.concat(start, F.lit(" até "), end)).otherwise("")


def guarantee_label(id: Column, name: Column) -> Column:
    return F.concat(id.cast("string"), F.lit(" - "), name)


def waiting_text(name: Column, amount: Column, unit: Column) -> Column:
    """Fixed waiting period of a coverage."""
    return sentence(WAITING, name=name, amount=amount, unit=F.lower(unit))


def progressive_period(start: Column, end: Column, unit: Column, open_end: Column | None = None) -> Column:
    """'De x até y meses', or 'A partir de x meses' if the end is 9999, or where open_end says so; instalments have no open end."""
    start, end = start.cast("string"), end.cast("string")
    months = F.when(end == "9999" if open_end is None else open_end, sentence(MONTHS_OPEN, start=start)).otherwise(sentence(MONTHS, start=start, end=end))
    return F.when(normalize_text(unit) == "MESES", months).otherwise(sentence(INSTALMENTS, start=start, end=end))


def label_lines(c: Column) -> Column:
    """One line under four words, else two halves; of an odd number the middle word is dropped."""
    words = F.split(c, " ")
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    return F.when(n < 4, F.array(c)).otherwise(F.array(F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, n - half + 1, half), " ")))
