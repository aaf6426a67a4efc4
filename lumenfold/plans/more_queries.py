"""Readers, settings, rules, pages and streams over text and rows made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import dates as D
from lumenfold.functions import money as M
from lumenfold.functions import nested as N
from lumenfold.functions import predicates as P
from lumenfold.functions import text as X
from lumenfold.operators import bindings as B
from lumenfold.operators import certificates as C
from lumenfold.operators import match as J
from lumenfold.operators import render, score
from lumenfold.operators import report as R
from lumenfold.operators.written import new_path
from lumenfold.plans.registry import query, table
from lumenfold.sources import documents as S
from lumenfold.sources import settings
from lumenfold.streaming import jobs


def _per_region(spark, sf_dir, item, head: str, tail: str, by: str = ""):
    """(doc_id, content): text of each region's nations."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("t")))).alias("x"))
    return rows.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: v["t"]), by), F.lit(tail)).alias("content"))


@query("""
SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS field_idx, 'N' || CAST(n_nationkey AS VARCHAR) AS name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'xs:string' ELSE 'xs:date' END AS type, CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '1' END AS min_occurs, '1' AS max_occurs, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS description FROM nation
""")
def schema_scan(spark, sf_dir):
    """Schemas of each region's nations, written as text and read."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    note = F.concat(F.lit("<xs:annotation><xs:documentation> "), name, F.lit(" </xs:documentation></xs:annotation>"))
    item = F.concat(F.lit('<xs:element name="N'), k.cast("string"), F.lit('"'), F.when(k % 3 > 0, ' type="xs:date"').otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(' minOccurs="0">'), note, F.lit("</xs:element>"))).otherwise("/>"), F.lit('<xs:element ref="r"/>'))
    files = _per_region(spark, sf_dir, item, '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">', "</xs:schema>")
    return S.schema_fields(files)


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(2 * count(*) AS INTEGER) AS elements, CAST(count(*) FILTER (WHERE n_nationkey % 2 = 0) AS INTEGER) AS optional, CAST(count(*) AS INTEGER) AS keys FROM nation GROUP BY n_regionkey""")
def file_counters(spark, sf_dir):
    """Elements, optional ones and top-level keys counted in text."""
    k = F.col("n_nationkey")
    xsd = _per_region(spark, sf_dir, F.concat(F.lit("<xs:element"), F.when(k % 2 == 0, ' minOccurs="0"').otherwise(""), F.lit("/><xs:element/>")), "<x>", "</x>")
    data = _per_region(spark, sf_dir, F.concat(F.lit('"k'), k.cast("string"), F.lit('": [1]')), "{", "}", ",").withColumnRenamed("content", "json")
    c = S.schema_counters(F.col("content"))
    return xsd.join(data, "doc_id").select("doc_id", c["elements"].alias("elements"), c["optional"].alias("optional"), S.top_level_keys(F.col("json")).alias("keys"))


@query("""
WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, n_nationkey % 4 AS t, n_nationkey, n_name FROM nation), t AS (SELECT doc_id, t, min(n_nationkey) AS first, arg_max(n_name, n_nationkey) AS value FROM n GROUP BY doc_id, t)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS key_idx, 'T' || CAST(t AS VARCHAR) AS key, value FROM t
""")
def xml_scan(spark, sf_dir):
    """XML of each region's nations: the last of equal tags counts, at the first one's place; blank ones and comments are left out."""
    tag = F.concat(F.lit("T"), (F.col("n_nationkey") % 4).cast("string"))
    item = F.concat(F.lit("<a:"), tag, F.lit("> "), F.col("n_name"), F.lit(" </a:"), tag, F.lit("><!-- c --><b> </b>"))
    return S.data_fields(_per_region(spark, sf_dir, item, '<r xmlns:a="u">', "</r>"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, '{' || string_agg('"k' || CAST(n_nationkey AS VARCHAR) || '": [' || CAST(n_nationkey AS VARCHAR) || ']', ',' ORDER BY n_nationkey) || '}' AS json FROM nation GROUP BY n_regionkey""")
def template_scan(spark, sf_dir):
    """Template data with a var, comments and trailing commas, as JSON."""
    item = F.concat(F.lit('"k'), F.col("n_nationkey").cast("string"), F.lit('": ['), F.col("n_nationkey").cast("string"), F.lit(",]"))
    return S.template_data(_per_region(spark, sf_dir, item, "var data = {", ",};", ",/* x */"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, '') || ' | ' || CASE WHEN l_quantity > 25 THEN l_linestatus ELSE '' END AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS row FROM lineitem WHERE l_linenumber < 7)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY l_orderkey
""")
def table_blocks(spark, sf_dir):
    """Each order's lines as a table block; null cells are empty, null rows are left out."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
    cells = F.when(F.col("l_linenumber") < 7, F.array("l_returnflag", F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))))
    return S.tables_to_blocks(lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table"), "row", cells.alias("cells"))).select("doc_id", "text")


@query("""
SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS raw, p_partkey % 3 > 0 AS valid FROM part
""")
def job_ids(spark, sf_dir):
    """Which ids are version 4 UUIDs."""
    h = F.md5(F.col("p_partkey").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("../"), uuid)).when(F.col("p_partkey") % 3 == 1, F.upper(uuid)).otherwise(uuid)
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("raw"), P.valid_job_id(given).alias("valid"))


@query("""
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, max(c_name) AS value FROM customer GROUP BY c_nationkey), s AS (SELECT CAST(s_nationkey AS VARCHAR) AS key, max(s_name) AS value FROM supplier WHERE s_nationkey < 10 GROUP BY s_nationkey)
SELECT coalesce(s.key, c.key) AS key, coalesce(s.value, c.value) AS value, CAST(CASE WHEN s.key IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version FROM c FULL JOIN s ON c.key = s.key WHERE coalesce(s.key, c.key) NOT IN ('3', '5')
""")
def settings_upserts(spark, sf_dir):
    """Two rounds of keyed changes, two keys removed, saved and loaded again; then a reset store."""
    pairs = lambda name, key, value: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    kept = settings.put(settings.put(settings.empty(spark), pairs("customer", "c_nationkey", "c_name")), pairs("supplier", "s_nationkey", "s_name").where("cast(key as int) < 10"))
    path = new_path(spark, "settings")
    settings.save(settings.remove(kept, spark.createDataFrame([("3",), ("5",)], "key string")), f"{path}/kept")
    settings.reset(spark, f"{path}/empty")
    return settings.load(spark, f"{path}/kept").union(settings.load(spark, f"{path}/empty"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '{"version":"1.0","name":"' || c_name || '","segment":"' || c_mktsegment || '"}' END AS project, c_custkey % 2 = 0 AS opened FROM customer""")
def project_files(spark, sf_dir):
    """Customers saved as projects; those of another version aren't opened."""
    saved = S.save_projects(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "c_custkey")
    other = F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.replace("content", F.lit('"1.0"'), F.lit('"2.0"')))
    return S.open_projects(saved.withColumn("content", other))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN html END AS html, url FROM pages)
SELECT page_id AS doc_id, 'index.html' AS name, md5(coalesce(html, '<!-- template vazio -->')) AS body FROM p UNION ALL SELECT page_id, 'css/style.css', md5('a{}') FROM p UNION ALL SELECT page_id, 'js/base.js', md5(url) FROM p UNION ALL SELECT page_id, 'exemplo.js', md5('') FROM p
""")
def bundle_files(spark, sf_dir):
    """Whole pages zipped, and what is in the bundles."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 > 0, F.col("html")).alias("html"), F.lit("a{}").alias("css"), F.col("url").alias("js"), F.lit(None).cast("string").alias("example"))
    return render.unbundled(render.bundles(rows)).select("doc_id", "name", F.md5("body").alias("body"))


@query("""
SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS unresolved_store, o_orderstatus = 'F' AS unresolved_page, o_orderkey % 3 > 0 AS gate_fields, o_orderkey % 2 = 0 AS gate_layout, o_orderkey % 5 > 0 AS gate_export,
  CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN o_totalprice WHEN 2 THEN 0.0 ELSE 'NaN'::DOUBLE END AS number, o_orderkey % 6 >= 4 OR o_orderkey % 6 = 2 AS useful,
  coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '—') AS first_or_dash, CASE WHEN o_orderkey % 2 = 0 THEN 'h' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 > 0 THEN 'i' ELSE 'none' END AS payload,
  CASE WHEN o_orderkey % 2 = 0 THEN '2.0' ELSE '1.0' END || ',' || '3.1' AS versions FROM orders
""")
def gates_and_payloads(spark, sf_dir):
    """Unresolved fields, route gates, numbers, useful values, first items, payloads and library versions."""
    k, n = F.col("o_orderkey"), F.lit(None)
    rows = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "not_found").otherwise("ok")
    gates = P.route_gates(F.when(k % 3 > 0, k), k % 2 == 0, k % 2 == 1, F.when(k % 5 > 0, F.lit("h")))
    given = F.element_at(F.array(F.lit(""), F.concat(F.lit(" "), F.col("o_totalprice").cast("string")), n.cast("string"), F.lit("x")), (k % 4 + 1).cast("int"))
    # Leaves as the rule sees them: a null leaf counts as text, blank ones and none at all don't.
    leaves = F.element_at(F.array(F.array().cast("array<string>"), F.array(F.lit(" ")), F.array(n.cast("string")), F.array(F.lit(""), F.lit("  ")), F.array(F.lit(""), F.lit("v")), F.array(F.lit("0"))), (k % 6 + 1).cast("int"))
    firsts = F.when(k % 3 > 0, F.array("o_orderpriority", F.lit("z"))).otherwise(F.array().cast("array<string>"))
    chosen = F.when(k % 2 == 0, F.create_map(F.lit("ko"), F.lit("2.0")))
    versions = P.library_versions(chosen, F.create_map(F.lit("ko"), F.lit("1.0"), F.lit("jq"), F.lit("3.1")))
    made = rows.withColumn("html", F.when(k % 2 == 0, F.concat(F.lit("h"), k.cast("string")))).withColumn("indexHtml", F.when(k % 3 > 0, "i"))
    return score.result_payload(made, {"payload": (["html", "indexHtml", "template"], F.lit("none"))}).select(
        "o_orderkey", P.unresolved(status, k % 2 == 1).alias("unresolved_store"), P.unresolved(status).alias("unresolved_page"), gates["fields"].alias("gate_fields"), gates["layout"].alias("gate_layout"), gates["export"].alias("gate_export"),
        P.number_of(given).alias("number"), N.has_useful_value(leaves).alias("useful"), N.first_or(firsts).alias("first_or_dash"), "payload", F.concat(versions["ko"], F.lit(","), versions["jq"]).alias("versions"),
    )


@query("""
SELECT s_suppkey, s_suppkey % 4 IN (1, 2) AS table_visible, s_suppkey % 3 = 0 AS card, s_suppkey % 6 = 0 AS card_first, s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 AS card_second, s_suppkey % 5 = 0 AS flag, s_suppkey % 7 < 4 AS waits, s_suppkey % 2 = 0 AS themed FROM supplier
""")
def customer_panels(spark, sf_dir):
    """Payment tables, assistance cards, flags, waiting periods and themes."""
    k = F.col("s_suppkey")
    some = lambda test: F.when(test, F.col("s_name")).otherwise(F.lit(" "))
    visible = P.payment_table_visible([some(k % 4 == 3), F.col("s_name")], [some(k % 4 > 0), F.lit("")])
    card = P.assistance_card(F.when(k % 3 == 0, "TRUE").otherwise("false"), F.array(F.when(k % 2 == 0, F.lit(" 9999998")).otherwise(F.lit("75440039")), F.lit("1")))
    rule = lambda r: F.struct(*[F.when(k % 7 == i, F.lit("x")).alias(n) for i, n in enumerate(("progressive", "defined", "causes", "suicide"))])
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", visible.alias("table_visible"), card["shown"].alias("card"), card["first"].alias("card_first"), card["second"].alias("card_second"), N.string_to_bool(F.when(k % 5 == 0, "True").otherwise("no")).alias("flag"),
        P.has_waiting_period(F.array(rule(0))).alias("waits"), P.partner_theme(F.lit("#fff"), some(k % 2 == 0), F.col("s_name")).alias("themed"),
    )


@query("""
WITH v AS (SELECT c_custkey, c_custkey % 6 AS r FROM customer)
SELECT c_custkey, [0, 1, 0, 1, 2, 0][r + 1] AS dropping, [0, 1, 1, 3, 2, 0][r + 1] AS keeping, [0, 1, 0, 3, 2, 0][r + 1] AS objects, [0, 0, 0, 3, 2, 0][r + 1] AS lists FROM v
""")
def array_variants(spark, sf_dir):
    """JSON as arrays by the four variants: with empties dropped, kept, without scalars, and without single objects."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("null", '{"a":1}', '"s"', '[null,{},{"a":1}]', '[{"a":1},{"b":2}]', "{}")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    size = lambda **how: F.size(N.json_to_array(text, **how))
    return table(spark, sf_dir, "customer").select("c_custkey", size(keep_empty=False, scalars=False).alias("dropping"), size().alias("keeping"), size(scalars=False).alias("objects"), size(scalars=False, single=False).alias("lists"))


@query("""
WITH l AS (SELECT l_orderkey, list({'p': l_partkey, 'q': l_quantity} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(len(x) AS INTEGER) AS flat, array_to_string([CAST(e.p AS VARCHAR) FOR e IN x[2:4]], ',') AS middle, len([e FOR e IN x IF e.q > 25]) > 0 AS any_large, x[1].q AS first_quantity, CAST(x[1].p + len(x) AS BIGINT) AS expanded,
  x[1].p AS subtitle, CAST(greatest(len(x) - 1, 0) AS INTEGER) AS rest, CAST(CASE WHEN len(x) > 1 THEN len(x) ELSE 0 END AS INTEGER) AS several FROM l
""")
def nested_lists(spark, sf_dir):
    """Flat maps, slices, membership, safe navigation, added fields and subtitles over each order's lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    # Lines in groups of a struct with a list, or without one: flatMap(item => item.lines || item).
    grouped = F.transform("x", lambda v: F.struct(F.when(v["l_quantity"] > 25, F.array(v)).alias("lines"), v.alias("own")))
    flat = F.flatten(F.transform(grouped, lambda g: F.coalesce(g["lines"], F.array(g["own"]))))
    first = F.try_element_at("x", F.lit(1))
    wider = first.withField("total", first["l_partkey"] + F.size("x"))
    names = F.transform("x", lambda v: v["l_partkey"].cast("string"))
    deductible, several = N.subtitle_and_rest(names), N.subtitle_and_rest(names, "several")
    return lines.select(
        "l_orderkey", F.size(flat).alias("flat"), F.array_join(F.transform(F.slice("x", 2, 3), lambda v: v["l_partkey"].cast("string")), ",").alias("middle"), F.exists("x", lambda v: v["l_quantity"] > 25).alias("any_large"),
        first["l_quantity"].alias("first_quantity"), wider["total"].alias("expanded"), deductible["subtitle"].cast("long").alias("subtitle"), F.size(deductible["items"]).alias("rest"), F.size(several["items"]).alias("several"),
    )


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'Não Informado') AS getter, 'x' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS safe, o_orderstatus || 'b' AS cleaned,
  CAST(o_custkey AS VARCHAR) || ' - ' || CAST(o_orderkey AS VARCHAR) AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'O seu seguro será atualizado pelo IPCA. Para mais informações, consulte as condições gerais.' ELSE '' END AS indexer,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(o_orderkey % 1000 AS DOUBLE) + 0.25 END AS money, CAST(floor(o_totalprice / 1024 + 0.5) AS BIGINT) AS kb,
  CASE o_orderkey % 3 WHEN 0 THEN 'mês' WHEN 1 THEN 'ano' END AS period, 'var data = {"k":' || CAST(o_orderkey AS VARCHAR) || '};' AS bound FROM orders
""")
def small_texts(spark, sf_dir):
    """Getters with defaults, safe and cleaned text, account and index sentences, leading numbers, sizes, periods and bound templates."""
    k = F.col("o_orderkey")
    even = lambda c: F.when(k % 2 == 0, c)
    number = F.when(k % 3 == 0, "x1").otherwise(F.concat((k % 1000).cast("string"), F.lit(" ,25")))
    data = F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.or_default(F.coalesce(even(F.col("o_orderpriority")), F.lit("")), "Não Informado").alias("getter"), B.text("x", even(F.col("o_custkey"))).alias("safe"),
        X.clean_trailing_ampersand(F.concat(F.col("o_orderstatus"), F.lit("b"), F.when(k % 2 == 0, "&amp; ").otherwise(".&"))).alias("cleaned"), C.account_label(F.col("o_custkey"), k).alias("account"),
        C.indexer_text(F.coalesce(even(F.lit("IPCA")), F.lit(""))).alias("indexer"), M.parse_leading_number(number).alias("money"), M.kilobytes(F.col("o_totalprice")).alias("kb"),
        D.periodicity(F.when(k % 3 == 0, "mensal").when(k % 3 == 1, "anual").otherwise("outro")).alias("period"), render.bind_template(F.lit("var data = ##TEMPLATE_DATA##;"), data).alias("bound"),
    )


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), p AS (SELECT o_custkey, CASE WHEN rn <= 15 THEN 0 ELSE 1 + (rn - 16) // 18 END AS page, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS keys FROM n GROUP BY ALL)
SELECT c_custkey, c_mktsegment, CAST(coalesce(page, 0) AS INTEGER) AS page, CAST(coalesce(n, 0) AS INTEGER) AS items, coalesce(keys, '') AS keys, CAST(coalesce(max(page) OVER (PARTITION BY c_custkey), 0) + 1 + 3 AS INTEGER) AS pages, coalesce(page, 0) = 0 AS first FROM customer LEFT JOIN p ON o_custkey = c_custkey
""")
def pages_with_parents(spark, sf_dir):
    """All customers' orders in pages of 15 then 18, with the customer's flag; one empty page without orders; three fixed pages more."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = R.pages(orders, "o_orderkey", ["o_orderkey"], 18, 15, ["c_custkey"], 3, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    keys = F.array_join(F.transform("items", lambda v: v["o_orderkey"].cast("string")), ",")
    return out.select("c_custkey", "c_mktsegment", "page", F.size("items").alias("items"), keys.alias("keys"), "pages", "first")


@query("""
WITH s AS (SELECT p_brand, sum(p_size) AS total FROM part GROUP BY p_brand), n AS (SELECT p_brand, row_number() OVER (ORDER BY total DESC, p_brand) AS rn FROM s)
SELECT CAST((rn - 1) // 16 AS INTEGER) AS page, string_agg(p_brand, ',' ORDER BY rn) AS brands, (SELECT CAST((max(rn) - 1) // 16 + 1 + 3 AS INTEGER) FROM n) AS pages FROM n GROUP BY (rn - 1) // 16
""")
def invoice_pages(spark, sf_dir):
    """Brands by their sizes in pages of 16, and the number of pages with three fixed ones."""
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("total")).withColumn("key", F.struct((-F.col("total")).alias("t"), "p_brand"))
    out = R.pages(sums, "key", ["p_brand"], extra_pages=3)
    return out.select("page", F.array_join(F.transform("items", lambda v: v["p_brand"]), ",").alias("brands"), "pages")


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_quantity AS h FROM lineitem),
p AS (SELECT l_orderkey, k, 0 AS page, 10 + h AS used FROM s WHERE k = 1 UNION ALL SELECT s.l_orderkey, s.k, CASE WHEN p.used + s.h > 100 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + s.h > 100 THEN 10 + s.h ELSE p.used + s.h END FROM p JOIN s ON s.l_orderkey = p.l_orderkey AND s.k = p.k + 1)
SELECT l_orderkey, string_agg(CAST(page AS VARCHAR), ',' ORDER BY k) AS pages, CAST(arg_max(CASE WHEN used + 30 > 100 THEN page + 1 ELSE page END, k) AS INTEGER) AS footer FROM p GROUP BY l_orderkey
""")
def height_paging(spark, sf_dir):
    """Lines by their heights on pages with a repeated header, and the page of the footer."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda v: v["l_quantity"]).alias("h"))
    paged = lines.withColumn("p", R.height_pages(F.col("h"), 100.0, 10.0))
    return paged.select("l_orderkey", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"), R.footer_page(F.col("h"), F.col("p"), 100.0, 10.0, 30.0).alias("footer"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running, coalesce(max(l_linenumber) OVER (PARTITION BY l_orderkey), 0) AS page_count FROM lineitem
""")
def running_totals(spark, sf_dir):
    """Running totals of each order's lines, and its number of pages as the largest page."""
    from pyspark.sql import Window

    rows = R.running_total(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", "running")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("running").cast("double").alias("running"), F.coalesce(F.max("l_linenumber").over(Window.partitionBy("l_orderkey")), F.lit(0)).alias("page_count"))


@query("""
WITH f AS (SELECT s_suppkey, s_name, n_nationkey, n_name, 1 - levenshtein(n_name, s_name) / greatest(length(s_name), length(n_name)) AS c FROM supplier, nation WHERE s_nationkey % 5 = n_regionkey),
r AS (SELECT * FROM f WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY c DESC, n_nationkey) <= 3)
SELECT s_suppkey, string_agg(n_name, ',' ORDER BY c DESC, n_nationkey) AS candidates FROM r GROUP BY s_suppkey
""")
def field_candidates(spark, sf_dir):
    """The three nations of a group whose names are nearest to each supplier's."""
    fields = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("doc_id"), F.col("s_suppkey").alias("field_idx"), F.col("s_name").alias("norm"))
    blocks = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("doc_id"), F.col("n_nationkey").alias("block_idx"), F.col("n_name").alias("text"), F.col("n_name").alias("norm"))
    return J.candidates(fields, blocks).select(F.col("field_idx").alias("s_suppkey"), F.array_join("candidates", ",").alias("candidates"))


@query("""
SELECT p_partkey, trim(lower(regexp_replace(translate('Nº da Apólice' || chr(160) || p_name || ' 1ª m²', 'ºª²ó' || chr(160), 'oa2o '), '[-_ ]+', ' ', 'g'))) AS name FROM part
""")
def label_names(spark, sf_dir):
    """Labels with ordinals, powers and no-break spaces as names."""
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_name(F.concat(F.lit("Nº da Apólice "), "p_name", F.lit(" 1ª m²"))).alias("name"))


@query("""SELECT event_id, epoch_us(ts) % 1200000000 > 600000000 AS expired, CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 60 WHEN 'purchase' THEN 85 ELSE 0 END AS pct FROM events""")
def previews_and_progress(spark, sf_dir):
    """Previews that are over their time, and the progress of phases."""
    ts = F.col("ts").cast("timestamp")
    made = table(spark, sf_dir, "events").select("event_id", "event_type", ts.alias("now"), F.timestamp_micros(F.unix_micros(ts) - F.unix_micros(ts) % 1_200_000_000).alias("created"))
    phase = F.when(F.col("event_type") == "click", "Extraindo PDF").when(F.col("event_type") == "view", "Matching de campos").when(F.col("event_type") == "purchase", "Gerando template").otherwise("x")
    return made.select("event_id", jobs.expired("created", "now").alias("expired"), F.coalesce(jobs.progress(phase), F.lit(0)).alias("pct"))


_FOLLOWED = """
WITH e AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'step' END AS event, CAST(event_id % 100 AS INTEGER) AS pct FROM events),
g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000, false) AS idle, row_number() OVER w AS rn, coalesce(lag(pct) OVER w, 0) AS before FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
f AS (SELECT job_id, coalesce(min(rn) FILTER (WHERE event <> 'step' OR idle), max(rn)) AS stop FROM g GROUP BY job_id)
SELECT g.job_id, CASE WHEN idle THEN 'error' WHEN event = 'step' THEN 'running' ELSE event END AS status, CASE WHEN idle THEN before WHEN event = 'done' THEN 100 WHEN event = 'error' THEN before ELSE pct END AS pct, CASE WHEN idle THEN 'timeout' END AS message FROM g JOIN f ON g.job_id = f.job_id AND rn = stop
"""


@query(_FOLLOWED)
def followed_jobs(spark, sf_dir):
    """Each job as its subscribers see it end: a stream with state per job, in which idle jobs end in error, given to two sinks."""
    from lumenfold.plans.job_queries import events_of

    out = new_path(spark, "followed")
    schema = table(spark, sf_dir, "events").schema
    stream = events_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")).withColumn("job_id", F.col("job_id").cast("string"))
    keep = lambda name: lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
    jobs.fan_out(jobs.stream_states(stream, event_time=True), [keep("one"), keep("two")], f"{out}/checkpoint").awaitTermination()
    kind = T.StructType.fromDDL(jobs.OUTPUT + ", epoch long")
    one, two = (spark.read.schema(kind).parquet(f"{out}/{n}") for n in ("one", "two"))
    last = lambda df: df.groupBy("job_id").agg(F.max_by(F.struct("status", "pct", "message"), "epoch").alias("s")).select(F.col("job_id").cast("long").alias("job_id"), "s.*")
    return last(one).intersect(last(two))
