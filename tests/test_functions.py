"""Scalar functions against expectations derived by hand and an independent model."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.functions import money as M
from lumenfold.functions import nested as N
from lumenfold.functions import predicates as P
from lumenfold.functions import text as T


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def model_name(s):
    return re.sub(r"[-_\s]+", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()).strip().lower()


def model_br(value):
    s = value.strip()
    if m := re.search(r"R?\$?\s*([0-9.]+),([0-9]{2})", s):
        return str(float(f"0{m[1].replace('.', '')}.{m[2]}"))
    if m := re.match(r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$", s):
        return f"{m[3]}-{m[2]}-{m[1]}"
    if re.match(r"^[0-9]{5}-[0-9]{3}$", s):
        return s
    d = re.sub(r"[^0-9]", "", s)
    return d if re.match(r"^[0-9\s()+-]+$", s) and len(d) >= 8 else s


def test_names_as_the_model(spark):
    r = random.Random(1)
    bits = "aBé-_ \t.ÇñÕ9—•Nome"
    values = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(500)] + ["NomeSegurado", "a.b_c--d", "—", ""]
    assert apply(spark, T.normalize_name, values) == [model_name(v) for v in values]
    assert apply(spark, T.normalize_name_exact, [*values, "ﬁ ½ ª"]) == [model_name(v) for v in [*values, "ﬁ ½ ª"]]


def test_br_values_as_the_model(spark):
    r = random.Random(2)
    fixed = ["R$ 1.234,56", "1.000,00", "10,555", "-5,20", "12.5", "", "31/12/2024", "99/99/2024", "2024-01-15", "12345-678", "(21) 99999-9999", "1234567", "  x  "]
    values = fixed + ["".join(r.choice("0123456789.,R$ /-()") for _ in range(r.randint(0, 16))) for _ in range(800)]
    got, want = apply(spark, M.normalize_br, values), [model_br(v) for v in values]
    assert [(v, g, w) for v, g, w in zip(values, got, want, strict=True) if g != w and "e+" not in w] == []


def test_similarity(spark):
    rows = spark.createDataFrame([("abc", "abc"), ("", "a"), ("kitten", "sitting"), ("", "")], "a string, b string")
    assert [round(r[0], 4) for r in rows.select(T.levenshtein_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5714, 1.0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (T.sanitize_identifier, "9 a-b", "_9_a_b"), (T.sanitize_identifier, "", "_field"), (T.escape_js, "a'\"\\\n", "a\\'\\\"\\\\\\n"), (T.escape_html, "<&>", "&lt;&amp;&gt;"),
    (T.cpf_mask, "123.456.789-01", "123.456.789-01"), (T.cpf_mask, "123", ""), (lambda c: T.cpf_mask(c, "left"), "1234567890", "012.345.678-90"), (lambda c: T.cpf_mask(c, "right"), "1234567890", "123.456.789-00"), (lambda c: T.cpf_mask(c, "pad"), "1234567", "123.456.700-00"),
    (T.cnpj_mask, "12ABC34501DE35", "12.ABC.345/01DE-35"), (T.cnpj_mask, "1234567890123", "01.234.567/8901-23"), (T.cnpj_mask, "12", "12"), (T.cep_mask, "12345678", "12345-678"), (T.cep_mask, "1", ""),
    (T.document_type, "1234567890", "CPF"), (T.document_type, "12-34", None), (T.cpf_or_cnpj_mask, "12345678901", "123.456.789-01"), (T.normalize_text, "ação Ñ", "ACAO N"), (T.clean_trailing_ampersand, "x&amp;", "x"),
    (T.or_default, "", ""), (M.format_currency_br, "1234.5", "R$ 1.234,50"), (M.format_currency_br, "abc", "abc"), (M.format_currency_br, "1.234,56", "R$ 1.234,56"), (M.parse_leading_number, "1.234,56", 1.234), (M.parse_leading_number, "x", 0.0),
    (M.format_percent_br, "12,5", "12,50%"), (M.loss_text, "-1", "0%"), (M.loss_text, "x", ""), (M.months_text, "25", "2 anos e 1 mês"), (M.months_text, "-1", "Vitalício"), (M.months_text, "0", "-"), (M.months_text, "5", "5 meses"),
    (D.iso_to_br, "2024-01-15T00:00", "15/01/2024"), (D.ymd_to_dmy, "x", "x"), (D.long_date, "05/03/2024", "05 de março de 2024"), (D.long_date, "5/3", ""), (D.long_date_capital, "", ""), (D.long_date_capital, "05/03/2024 10:00", "05 de Março de 2024"),
    (D.long_date_checked, "05/13/2024", ""), (D.long_date_checked, "05/03/2024", "5 de março de 2024"), (D.birth_date, "1/2", ""), (D.any_date_br, "2024-01-15", "15/01/2024"), (D.any_date_br, "soon", "soon"), (D.request_date, None, None), (D.periodicity, "anual", "ano"), (M.loss_text, "12,50", "Identificado uma perda funcional de 12.5% da sequela"), (T.cnpj_mask, "1*", "1*"), (T.cpf_or_cnpj_mask, "12.abc.345/01de-35", "12.abc.345/01de-35"), (D.periodicity, "x", None),
    (P.field_type, "xs:date", "text"), (P.field_type, "dateTime", "date"), (P.is_renewal, "0", False), (P.is_renewal, "x", True), (P.is_renewal, None, False), (P.is_saf, "Plano sáf", True), (lambda c: P.is_saf(c, True), "plansaf", False), (P.number_of, "", 0.0), (N.string_to_bool, "TRUE", True),
    (P.valid_job_id, "123e4567-e89b-42d3-a456-426614174000", True), (P.valid_job_id, "123e4567-e89b-12d3-a456-426614174000", False),
])
def test_values(spark, f, value, want):
    assert apply(spark, f, [value]) == [want]


def test_number_ties_go_up(spark):
    assert apply(spark, M.format_number_br, [0.125, 1234.5, -2.5, None], "double") == ["0,13", "1.234,50", "-2,50", "—"]
    assert apply(spark, lambda c: M.format_number_br(c, 0), [2.5], "double") == ["3"]
    assert apply(spark, lambda c: M.format_number_br(c, 0, True), [2.5], "double") == ["2,50"]


def test_arrays_of_json(spark):
    values = [None, "{}", '""', '{"a":1}', "[]", '[null, {}, {"a": 2}]', '"x"']
    assert apply(spark, lambda c: F.size(N.json_to_array(c)), values) == [0, 0, 0, 1, 0, 3, 1]
    assert apply(spark, lambda c: F.size(N.json_to_array(c, keep_empty=False, scalars=False)), values) == [0, 0, 0, 1, 0, 1, 0]
    assert apply(spark, lambda c: F.size(N.json_to_array(c, single=False)), values) == [0, 0, 0, 0, 0, 3, 1]


def test_flatten(spark):
    got = apply(spark, N.flatten_json, ['{"a": {"b": [1, true, null, {"c": 1000.00}], "d": {}, "e": []}}', "[1]", "x", None])
    assert [[(x.path, x.value) for x in g] if g is not None else None for g in got] == [[("a.b.0", "1"), ("a.b.1", "True"), ("a.b.2", ""), ("a.b.3.c", "1000.0")], [("0", "1")], None, []]


def test_lists(spark):
    assert apply(spark, N.slice_halves, [["a", "b", "c"], [], ["a"]], "array<string>") == [(["a", "b"], ["c"]), ([], []), (["a"], [])]
    assert apply(spark, N.distinct_joined, [[" b", "a", "b ", "", None]], "array<string>") == ["b, a"]
    assert apply(spark, N.subtitle_and_rest, [["s", "x", "y"], []], "array<string>") == [("s", ["x", "y"]), (None, [])]
    assert apply(spark, T.label_lines, ["a b c", "a b c d e"]) == [["a b c"], ["a b", "d e"]]
    assert apply(spark, N.has_useful_value, [["", " "], [None], []], "array<string>") == [False, True, False]
    assert apply(spark, P.color_list, ["a, ,b ,"]) == [["a", "b"]]
    assert apply(spark, lambda c: N.any_true(c), [["True"], ["x"]], "array<string>") == [True, False]


def test_default_fill(spark):
    df = spark.createDataFrame([(None, (None, [(None,)]), None)], "a string, s struct<b string, c array<struct<d string>>>, n array<struct<e string>>")
    row = N.default_fill(df).first()
    assert row.a == "" and row.s.b == "" and row.s.c[0].d == "" and row.n == []


def test_rules(spark):
    df = spark.createDataFrame([("ITA", ["a"], []), ("ITA", [P.INCAPACITY], []), ("X", ["a"], ["b"]), ("ID", ["a"], []), ("IA", [], []), ("IA", None, ["b"])], "s string, c array<string>, ia array<string>")
    rules = lambda v: [tuple(r.r) for r in df.select(P.event_rules(F.col("s"), F.col("c"), F.col("ia"), v).alias("r")).collect()]
    assert rules(2) == [(False, True, False), (True, False, False), (True, False, False), (True, False, False), (True, False, False), (False, False, True)]
    assert rules(1) == [(False, True, False), (False, True, False), (True, False, False), (False, True, False), (True, False, False), (False, False, True)]
    one = spark.range(1)
    lit = lambda *v: [F.lit(x) for x in v]
    assert one.select(P.payment_table_visible(lit("a", " "), lit("", "b"))).first()[0] is True
    assert one.select(P.file_divergences(F.lit(0), F.lit("a.XSD"), F.lit("b.txt"))).first()[0] == ["PDF vazio.", "Arquivo de dados deve ser JSON ou XML."]
    assert one.select(P.library_versions(F.create_map(F.lit("a"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")))).first()[0] == {"a": "2", "b": "1"}
    assert tuple(one.select(P.assistance_card(F.lit("True"), F.array(F.lit(" 7 ")), ("7", "8"))).first()[0]) == (True, True, False)
    assert one.select(P.all_blank(lit("", " ")), P.all_filled(lit("a", "")), P.partner_theme(*lit("a", "b", "c"))).first()[:] == (True, False, True)
    assert one.select(T.period_text(*lit("1", "2")), T.period_text(*lit("1", "")), T.period_text(*lit("1", "2"), hours=False)).first()[:] == ("1 00h \naté 2 23h59", "1 00h", "1 até 2")
    assert one.select(M.exclusion_age(F.lit(0), F.lit(True), F.lit("10"), F.lit(30)), M.clamp_page(F.lit(9), F.lit(3)), M.kilobytes(F.lit(2048))).first()[:] == (40, 3, 2)


def test_more_rules(spark):
    df = spark.createDataFrame([(1, None, "x", True, "ok", 55.0), (2, "e", None, False, "not_found", 85.0)], "i int, extraction string, html string, yes boolean, status string, score double").orderBy("i")
    gates = [tuple(r[0]) for r in df.select(P.route_gates(F.col("extraction"), F.col("yes"), F.col("yes"), F.col("html"))).collect()]
    assert gates == [(False, True, True, True), (True, False, False, False)]
    assert [tuple(r) for r in df.select(P.unresolved(F.col("status")), P.unresolved(F.col("status"), ~F.col("yes")), P.fidelity_low(F.col("score"))).collect()] == [(False, False, True), (True, False, False)]
    rules = spark.createDataFrame([([(None, None, None, None)],), ([(None, "d", None, None)],), ([],)], "r array<struct<progressive string, defined string, causes string, suicide string>>")
    assert [r[0] for r in rules.select(P.has_waiting_period(F.col("r"))).collect()] == [False, True, False]
    one = spark.range(1)
    assert one.select(N.first_or(F.array(F.lit("a"), F.lit("b"))), N.first_or(F.array().cast("array<string>"))).first()[:] == ("a", "—")
    who = P.participant(F.struct(F.lit(" BENEFICIARIO indefinido").alias("name"), F.lit("1").alias("doc")), F.struct(F.lit("r").alias("name"), F.lit("2").alias("doc")))
    assert tuple(one.select(who).first()[0]) == ("r", "2")
    parts = T.address_parts(*[F.lit(x) for x in ("Rua A", "", "ap 1", "Centro", "", "RJ", "123")])
    assert tuple(one.select(parts).first()[0]) == ("123", "Rua A", "", ", Bairro Centro", "", "RJ")
    assert one.select(T.address(F.lit("Rua"), F.lit(""), F.lit("ap"))).first()[0] == "Rua, ap"


def test_names_by_full_decomposition(spark):
    import re
    import unicodedata

    texts = ["Nº da Apólice", "nome\u00a0segurado", "1ª via", "m² ½ … ™ ﬁm", "ＡＢ－c", "𝐀x", "ß Æ", *("a" + "".join(map(chr, range(a, a + 64))) + "z" for a in range(0x80, 0xD800, 64))]
    want = [re.sub(r"[-_\s]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).strip().lower() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(T.normalize_name(F.col("t"))).collect()] == want


def test_rounding_as_python(spark):
    import random

    r = random.Random(1)
    values = [0.12345, 0.05, 0.5, 2.5, 0.125, 0.90625, -0.12345, 1.00005, 0.0, 1e12 + 0.5, *(r.random() for _ in range(3000)), *(r.randrange(20000) / 20000 for _ in range(3000)), *(a / b for a in range(1, 40) for b in range(a, 40))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.round_even(F.col("v"), 4).alias("a"), M.round_even(F.col("v"), 1).alias("b"), M.percent_position(F.col("v")).alias("p"))
    for x in rows.collect():
        assert (x.a, x.b, x.p) == (round(x.v, 4), round(x.v, 1), f"{x.v * 100:.1f}"), x


def test_very_large_money(spark):
    many = "1" * 40
    one = spark.createDataFrame([(f"{many},00", 1e30, "12345678901234567,89", "123456789012345,60")], "a string, b double, c string, d string")
    got = one.select(M.normalize_br(F.col("a")), M.format_number_br(F.col("b")), M.format_currency_br(F.col("b")), M.normalize_br(F.col("c")), M.normalize_br(F.col("d"))).first()
    dots = ".".join(["1", *["000"] * 10])
    assert got[:] == (str(float(many)), f"{dots},00", f"R$ {dots},00", str(float("12345678901234567.89")), "123456789012345.6")
