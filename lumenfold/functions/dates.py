"""Dates as text, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months' names.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def _month(number: Column, capital: bool = False) -> Column:
    return F.try_element_at(F.array(*[F.lit(m.capitalize() if capital else m) for m in MONTHS]), number.try_cast("int"))


def iso_to_br(c: Column) -> Column:
    """YYYY-MM-DDT… to DD/MM/YYYY by cutting text."""
    return F.array_join(F.reverse(F.split(F.substring_index(c, "T", 1), "-")), "/")


def ymd_to_dmy(c: Column) -> Column:
    """YYYY-MM-DD to DD/MM/YYYY, else unchanged."""
    return F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")


def long_date(c: Column, place: str | None = None, least: int = 10) -> Column:
    """DD/MM/YYYY… as 'DD de mês de YYYY', by offsets; '' if shorter than least."""
    text = F.concat(F.substring(c, 1, 2), F.lit(" de "), _month(F.substring(c, 4, 2)), F.lit(" de "), F.substring(c, 7, 4))
    return F.when(F.length(c) >= least, F.concat(F.lit(f"{place}, "), text) if place else text).otherwise("")


def long_date_capital(c: Column) -> Column:
    """DD/MM/YYYY with or without a time as 'DD de Mês de YYYY'; '' for blank."""
    d = F.split(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), "/")
    text = F.concat(F.try_element_at(d, F.lit(1)), F.lit(" de "), _month(F.try_element_at(d, F.lit(2)), True), F.lit(" de "), F.try_element_at(d, F.lit(3)))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(text)


def long_date_checked(c: Column) -> Column:
    """As long_date, with the day as a number; '' unless the day is 1-31 and the month 1-12."""
    d = F.split(c, "/")
    part = lambda k: F.try_element_at(d, F.lit(k)).try_cast("int")
    ok = part(1).between(1, 31) & part(2).between(1, 12) & part(3).isNotNull()
    return F.when(ok, F.concat(part(1).cast("string"), F.lit(" de "), _month(part(2)), F.lit(" de "), part(3).cast("string"))).otherwise("")


def long_date_of(c: Column) -> Column:
    """A date column in words."""
    d = c.cast("date")
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), _month(F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def place_and_date(place: Column, c: Column) -> Column:
    """'place, DD de mês de YYYY' by the slashes; '' for up to 7 characters."""
    part = lambda k: F.split_part(c, F.lit("/"), F.lit(k))
    return F.when(F.length(c) > 7, F.concat(place, F.lit(", "), part(1), F.lit(" de "), _month(part(2)), F.lit(" de "), part(3))).otherwise("")


def birth_date(c: Column) -> Column:
    """Without the time; '' unless there are three parts."""
    day = F.split_part(c, F.lit(" "), F.lit(1))
    return F.when(F.size(F.split(day, "/")) == 3, day).otherwise("")


def any_date_br(c: Column) -> Column:
    """DD/MM/YYYY as it is, an ISO date or timestamp as DD/MM/YYYY, else unchanged."""
    parsed = F.coalesce(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), c).otherwise(F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), c))


def request_date(c: Column) -> Column:
    """The day of 'YYYY-MM-DD[T ]…' as DD/MM/YYYY; null if absent."""
    return F.array_join(F.reverse(F.split(F.element_at(F.split(c, "[T ]"), 1), "-")), "/")


def periodicity(c: Column) -> Column:
    """mensal to mês and so on; null for others."""
    # Periods and their nouns.
    names = {"mensal": "mês", "trimestral": "trimestre", "semestral": "semestre", "anual": "ano", "unico": "único"}
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out
