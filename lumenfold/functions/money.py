"""Numbers and money in Brazilian notation, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import digits


def normalize_br(c: Column) -> Column:
    """A normalised value: money anywhere in it, then DD/MM/YYYY, CEP, phone, else the trimmed text.

    Money loses its sign and further decimals; dates aren't checked; an ISO date counts as a phone number.
    """
    s = F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    money = r"R?\$?\s*([0-9.]+),([0-9]{2})"
    whole = F.replace(F.regexp_extract(s, money, 1), F.lit("."), F.lit(""))
    # As a float prints: two decimals, of which a last 0 goes; from 1e16 on with an exponent.
    number = F.concat(F.lit("0"), whole, F.lit("."), F.regexp_extract(s, money, 2)).try_cast("double")
    short = F.regexp_replace(number.try_cast("decimal(38,2)").cast("string"), "0$", "")
    large = F.replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), F.lit("E"), F.lit("e+"))
    text = F.when(number == float("inf"), "inf").when(number >= 1e16, large).otherwise(short)
    date = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
    return (
        F.when(s.rlike(money), text)
        .when(s.rlike(date), F.regexp_replace(s, date, "$3-$2-$1"))
        .when(s.rlike(r"^[0-9]{5}-[0-9]{3}$"), s)
        .when(s.rlike(r"^[0-9\s()\-+]+$") & (F.length(digits(s)) >= 8), digits(s))
        .otherwise(s)
    )


def _formatted(x: Column, decimals: int) -> Column:
    """1,234.56 of a finite double; halves of the printed value go up. Beyond 27 digits there are no decimals to round."""
    exact = F.format_number(F.round(x.try_cast("decimal(38,10)"), decimals), decimals)
    return F.when(F.abs(x) < 1e27, exact).otherwise(F.format_number(x, decimals))


def _swapped(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def format_number_br(c: Column, decimals: int = 2, zero_means_two: bool = False) -> Column:
    """1.234,56; halves go up; a dash for null and what is no finite number."""
    d = 2 if zero_means_two and not decimals else decimals
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "—").otherwise(_swapped(_formatted(x, d)))


def parse_money(c: Column) -> Column:
    """Without what is no digit, comma or minus, comma as the point; null if that is no number."""
    return F.replace(F.regexp_replace(c, "[^0-9,-]", ""), F.lit(","), F.lit(".")).try_cast("double")


def format_currency_br(c: Column) -> Column:
    """R$ 1.234,56 of a number or of money text; other text stays as it is."""
    x = F.coalesce(c.cast("string").try_cast("double"), parse_money(c.cast("string")))
    return F.when(x.isNull(), c.cast("string")).otherwise(F.concat(F.lit("R$ "), _swapped(_formatted(x, 2))))


def parse_leading_number(c: Column) -> Column:
    """White space dropped, the first comma a point, then the number it begins with; 0 if none. 1.234,56 gives 1.234."""
    s = F.regexp_replace(F.regexp_replace(c, r"\s", ""), "^([^,]*),", "$1.")
    return F.coalesce(F.regexp_extract(s, r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double"), F.lit(0.0))


def format_percent_br(c: Column) -> Column:
    """Two decimals, a comma and %; null for no number."""
    x = F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("decimal(38,10)")
    return F.concat(F.replace(F.round(x, 2).cast("decimal(38,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("%"))


def loss_text(c: Column) -> Column:
    """A sentence for a number above 0, 0% for another, '' for no number."""
    x = F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"^\s*[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("decimal(30,10)")
    shown = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x > 0, F.concat(F.lit("Identificado uma perda funcional de "), shown, F.lit("% da sequela"))).when(x <= 0, "0%").otherwise("")


def months_text(months: Column, lifetime: bool = True) -> Column:
    """'2 anos e 3 meses', singular forms, '-' for null and 0; -1 is 'Vitalício' if lifetime."""
    m = months.cast("string").try_cast("int")
    years, rest = F.floor(m / 12), m % 12
    named = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))
    y, r = named(years, " ano", " anos"), named(rest, " mês", " meses")
    out = F.when(m.isNull() | (m == 0), "-").when((years > 0) & (rest > 0), F.concat(y, F.lit(" e "), r)).when(years > 0, y).otherwise(r)
    return F.when(m == -1, "Vitalício").otherwise(out) if lifetime else out


def equivalence(benefit: Column, income: Column) -> Column:
    """ceil(benefit / income), null for no income."""
    return F.ceil(F.try_divide(benefit, income))


def exclusion_age(age: Column, fixed_term: Column, term: Column, current: Column) -> Column:
    """0 stands for term + current age with a fixed term, else for 100."""
    return F.when(age == 0, F.when(fixed_term, term.try_cast("int") + current).otherwise(100)).otherwise(age)


def clamp_page(page: Column, total: Column) -> Column:
    return F.least(F.greatest(F.lit(1), page), total)


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024).cast("long")


def percent_position(c: Column) -> Column:
    """A 0-1 position as a percentage with one decimal."""
    return F.format_string("%.1f", round_even(c * 100, 1))


def round_even(c: Column, decimals: int) -> Column:
    """A double rounded by its exact binary value, and halves to even if it is exactly one.

    q is the nearest whole number to c in units of half a last place. Only if q is odd can c be near a half, and then the sign of
    c * k - q decides; both products with the parts of c are exact.
    """
    x, k = c.cast("double"), 2.0 * 10**decimals
    big = x * 134217729.0
    high = big - (big - x)
    q = F.rint(x * k)
    over = (high * k - q) + (x - high) * k
    odd = F.abs(q) % 2 == 1
    lower = (q - 1) / 2
    half = F.when(over > 0, lower + 1).when(over < 0, lower).otherwise(F.when(F.abs(lower) % 2 == 0, lower).otherwise(lower + 1))
    return F.when(F.abs(x) < 1e11, F.when(odd, half).otherwise(q / 2) / 10.0**decimals).otherwise(x)
