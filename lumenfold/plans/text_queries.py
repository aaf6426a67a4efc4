"""Scalar functions over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.functions import money as M
from lumenfold.functions import nested as N
from lumenfold.functions import text as T
from lumenfold.plans.registry import query, table


@query("""
SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS number_br, 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS currency_br,
  replace(format('{:.2f}', CAST(o_orderkey % 1000 AS DOUBLE) / 4), '.', ',') || '%' AS percent_br FROM orders
""")
def br_numbers(spark, sf_dir):
    """Order totals as numbers and money, and percentages."""
    c = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.format_number_br(c).alias("number_br"), M.format_currency_br(c.cast("decimal(18,2)")).alias("currency_br"), M.format_percent_br((F.col("o_orderkey") % 1000 / 4).cast("string")).alias("percent_br"))


_MIXED = """CASE o_orderkey % 5 WHEN 0 THEN 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN 2 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN '(21) 9' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ELSE '  ' || o_orderpriority || ' ' END"""


@query(f"""
WITH s AS (SELECT o_orderkey, trim({_MIXED}) AS v FROM orders),
m AS (SELECT *, regexp_extract(v, 'R?\\$?\\s*([0-9.]+),([0-9]{{2}})', 1) AS w, regexp_extract(v, 'R?\\$?\\s*([0-9.]+),([0-9]{{2}})', 2) AS c FROM s)
SELECT o_orderkey, CASE WHEN w <> '' THEN regexp_replace(CAST(CAST('0' || replace(w, '.', '') || '.' || c AS DECIMAL(38,2)) AS VARCHAR), '0$', '')
 WHEN regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN v[7:10] || '-' || v[4:5] || '-' || v[1:2] WHEN regexp_full_match(v, '[0-9]{{5}}-[0-9]{{3}}') THEN v
 WHEN regexp_full_match(v, '[0-9 ()+-]+') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8 THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE v END AS normalized FROM m
""")
def normalize_br(spark, sf_dir):
    """Money, dates, CEPs, phones and other text normalised."""
    k = F.col("o_orderkey")
    mixed = (
        F.when(k % 5 == 0, M.format_currency_br(F.col("o_totalprice").cast("decimal(18,2)")))
        .when(k % 5 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(k % 5 == 2, F.concat(F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("-"), F.lpad((k % 1000).cast("string"), 3, "0")))
        .when(k % 5 == 3, F.concat(F.lit("(21) 9"), F.lpad(k.cast("string"), 8, "0")))
        .otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", M.normalize_br(mixed).alias("normalized"))


@query(r"""
SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[-_\s\x0b]+', ' ', 'g')))) AS name_md5,
  md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5,
  md5(replace(replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), '"', '\"'), chr(10), '\n'), chr(13), '\r')) AS js_md5 FROM documents
""")
def normalize_texts(spark, sf_dir):
    """Whole texts as names, and escaped for HTML and scripts."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_name(c)).alias("name_md5"), F.md5(T.escape_html(c)).alias("html_md5"), F.md5(T.escape_js(c)).alias("js_md5"))


@query(r"""
SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS ident, '_' || regexp_replace(CAST(p_partkey AS VARCHAR) || '-' || p_name, '[^a-zA-Z0-9_]', '_', 'g') AS numbered,
  split_part(p_name, ' ', 1) AS first_word, upper(strip_accents(p_name)) AS upper_name FROM part
""")
def sanitize_identifiers(spark, sf_dir):
    """Part names as identifiers."""
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.sanitize_identifier(c).alias("ident"), T.sanitize_identifier(F.concat(F.col("p_partkey").cast("string"), F.lit("-"), c)).alias("numbered"), T.first_token(c).alias("first_word"), T.normalize_text(c).alias("upper_name"))


@query("""
SELECT s_suppkey, n_name, round_even(CASE WHEN s_name = n_name THEN 1 ELSE 1 - levenshtein(s_name, n_name) / greatest(length(s_name), length(n_name)) END, 4) AS similarity FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def lev_similarity(spark, sf_dir):
    """Suppliers' names against their nations'."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "n_name", M.round_even(T.levenshtein_similarity(F.col("s_name"), F.col("n_name")), 4).alias("similarity"))


@query(r"""
WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS d11, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS d14, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS d8 FROM customer)
SELECT c_custkey, regexp_replace(d11, '(\d{3})(\d{3})(\d{3})(\d{2})', '\1.\2.\3-\4') AS cpf, regexp_replace(d14, '(.{2})(.{3})(.{3})(.{4})(.{2})', '\1.\2.\3/\4-\5') AS cnpj,
  regexp_replace(d8, '(\d{5})(\d{3})', '\1-\2') AS cep, CASE c_custkey % 3 WHEN 0 THEN 'CPF' WHEN 1 THEN 'CNPJ' END AS kind,
  regexp_replace('0' || substr(d11, 2), '(\d{3})(\d{3})(\d{3})(\d{2})', '\1.\2.\3-\4') AS cpf_left, regexp_replace(substr(d11, 2) || '0', '(\d{3})(\d{3})(\d{3})(\d{2})', '\1.\2.\3-\4') AS cpf_right FROM c
""")
def document_masks(spark, sf_dir):
    """Customer keys as CPF, CNPJ and CEP."""
    k = F.col("c_custkey").cast("string")
    d11, d14, d8 = (F.lpad(k, n, "0") for n in (11, 14, 8))
    kind = T.document_type(F.when(F.col("c_custkey") % 3 == 0, d11).when(F.col("c_custkey") % 3 == 1, d14).otherwise(d8))
    ten = F.substring(d11, 2, 10)
    return table(spark, sf_dir, "customer").select("c_custkey", T.cpf_mask(d11).alias("cpf"), T.cnpj_mask(d14).alias("cnpj"), T.cep_mask(d8).alias("cep"), kind.alias("kind"), T.cpf_mask(ten, "left").alias("cpf_left"), T.cpf_mask(ten, "right").alias("cpf_right"))


_MONTHS = "['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro']"


@query(f"""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS ymd,
  'Rio de Janeiro, ' || strftime(o_orderdate, '%d') || ' de ' || ({_MONTHS})[month(o_orderdate)] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS long_text,
  strftime(o_orderdate, '%d') || ' de ' || upper(({_MONTHS})[month(o_orderdate)][1:1]) || ({_MONTHS})[month(o_orderdate)][2:] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS capital,
  CAST(day(o_orderdate) AS VARCHAR) || ' de ' || ({_MONTHS})[month(o_orderdate)] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS checked,
  CAST(day(o_orderdate) AS VARCHAR) || ' de ' || ({_MONTHS})[month(o_orderdate)] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS of_date,
  'Rio, ' || strftime(o_orderdate, '%d') || ' de ' || ({_MONTHS})[month(o_orderdate)] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS placed,
  strftime(o_orderdate, '%d/%m/%Y') AS birth, strftime(o_orderdate, '%d/%m/%Y') AS any_date, strftime(o_orderdate, '%d/%m/%Y') AS requested FROM orders
""")
def long_dates(spark, sf_dir):
    """Order dates in all notations."""
    br, ymd = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.iso_to_br(F.concat(ymd, F.lit("T10:00:00"))).alias("iso"), D.ymd_to_dmy(ymd).alias("ymd"), D.long_date(br, "Rio de Janeiro").alias("long_text"),
        D.long_date_capital(F.concat(br, F.lit(" 10:00"))).alias("capital"), D.long_date_checked(br).alias("checked"), D.long_date_of(F.col("o_orderdate")).alias("of_date"),
        D.place_and_date(F.lit("Rio"), br).alias("placed"), D.birth_date(F.concat(br, F.lit(" 00:00"))).alias("birth"), D.any_date_br(ymd).alias("any_date"), D.request_date(F.concat(ymd, F.lit(" 09:30"))).alias("requested"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size = 0 THEN '-' ELSE concat_ws(' e ', CASE WHEN p_size // 12 > 0 THEN CAST(p_size // 12 AS VARCHAR) || CASE WHEN p_size // 12 = 1 THEN ' ano' ELSE ' anos' END END,
  CASE WHEN p_size % 12 > 0 THEN CAST(p_size % 12 AS VARCHAR) || CASE WHEN p_size % 12 = 1 THEN ' mês' ELSE ' meses' END END) END AS months,
  CASE WHEN p_size > 25 THEN 'Identificado uma perda funcional de ' || CAST(p_size - 25 AS VARCHAR) || '% da sequela' ELSE '0%' END AS loss, CAST(ceil(p_retailprice / p_size) AS BIGINT) AS equivalent,
  CASE WHEN p_size % 10 = 0 THEN CASE WHEN p_size > 25 THEN 40 + p_size ELSE 100 END ELSE p_size % 10 END AS age, greatest(1, least(p_size, 30)) AS page FROM part
""")
def months_and_rules(spark, sf_dir):
    """Part sizes as months, losses, ages and pages."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.months_text(s).alias("months"), M.loss_text(s - 25).alias("loss"), M.equivalence(F.col("p_retailprice"), s).alias("equivalent"),
        M.exclusion_age(s % 10, s > 25, F.lit("40"), s).alias("age"), M.clamp_page(s, F.lit(30)).alias("page"),
    )


@query("""SELECT event_id, CAST(0 AS BIGINT) AS idx, e.key AS path, e.value::VARCHAR AS value FROM events, json_each(props) e""")
def json_props_flatten(spark, sf_dir):
    """Leaves of the events' properties."""
    return table(spark, sf_dir, "events").select("event_id", F.inline(N.flatten_json(F.col("props"))))


@query("""
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, array_to_string(list_distinct_sorted, ',') AS lengths FROM (SELECT doc_id, text, list_sort(list_distinct([length(trim(x)) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])) AS list_distinct_sorted FROM documents)
""")
def text_lines(spark, sf_dir):
    """Lines of whole texts: their number and the distinct lengths of those that aren't blank."""
    lines = N.compact(F.split("text", "\n"))
    sizes = F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.length(F.trim(x)))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.array_join(sizes.cast("array<string>"), ",").alias("lengths"))


@query(r"""
SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', 1) ELSE url END AS question, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) ELSE '' END AS rest,
  (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs, replace(url, '''', '') AS clean FROM pages
""")
def split_questions(spark, sf_dir):
    """URLs cut at their first #, and paragraphs counted in whole pages."""
    q = T.split_question(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", q["question"].alias("question"), q["rest"].alias("rest"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), T.clean_quotes(F.col("url")).alias("clean"))


@query("""
WITH w AS (SELECT o_orderkey, string_split(array_to_string([o_orderpriority, CAST(o_custkey AS VARCHAR), 'x', o_orderstatus, 'y'][1:1 + o_orderkey % 5], ' '), ' ') AS w FROM orders)
SELECT o_orderkey, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:len(w) // 2], ' ') || '|' || array_to_string(w[len(w) - len(w) // 2 + 1:], ' ') END AS lines FROM w
""")
def label_lines(spark, sf_dir):
    """Labels of all orders, of one to six words, in lines."""
    words = F.array("o_orderpriority", F.col("o_custkey").cast("string"), F.lit("x"), "o_orderstatus", F.lit("y"))
    label = F.array_join(F.slice(words, F.lit(1), (1 + F.col("o_orderkey") % 5).cast("int")), " ")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.label_lines(label), "|").alias("lines"))
