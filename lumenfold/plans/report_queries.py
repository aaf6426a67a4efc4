"""Summaries, pages, chunks, first rows, lists and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import report as R
from lumenfold.plans.registry import query, table


@query("""
WITH s AS (SELECT p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT p_brand, quantity, total, CAST(floor((row_number() OVER (ORDER BY total DESC, p_brand) - 1) / 16) AS BIGINT) AS page FROM s
""")
def invoice_summary(spark, sf_dir):
    """Sums by brand, largest first, in pages of 16."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = R.summarize(items.select("p_brand", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total"), "l_orderkey"), ["p_brand"], ["quantity", "total"], "l_orderkey")
    rows = R.numbered(sums, [F.desc("total"), F.col("p_brand")])
    return rows.select("p_brand", F.col("quantity").cast("double").alias("quantity"), F.col("total").cast("double").alias("total"), R.page_of(F.col("rn"), 16).cast("long").alias("page"))


@query("""
WITH s AS (SELECT l_partkey, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_suppkey, l_shipdate)) AS first_ship,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS lines FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, first_ship, total, lines, CAST(floor((row_number() OVER (ORDER BY total DESC, l_partkey) - 1) / 16) AS BIGINT) AS page FROM s
""")
def invoice_detail_pages(spark, sf_dir):
    """Sums by part with the first row's date, in pages of 16."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.min_by("l_shipdate", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")).alias("first_ship"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("lines"),
    )
    rows = R.numbered(sums, [F.desc("total"), F.col("l_partkey")])
    return rows.select("l_partkey", "first_ship", "total", "lines", R.page_of(F.col("rn"), 16).cast("long").alias("page"))


@query("""
SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
  arg_min(coalesce(l_tax, 0), (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first_tax FROM lineitem
""")
def invoice_totals(spark, sf_dir):
    """Grand totals and the first row's tax."""
    first = F.min_by(F.coalesce("l_tax", F.lit(0.0)), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("first_tax")
    sums = [F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(n) for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "total"))]
    return table(spark, sf_dir, "lineitem").agg(*sums, first)


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, CAST(CASE WHEN rn <= 15 THEN 0 ELSE 1 + floor((rn - 16) / 18) END AS BIGINT) AS plan_page,
  CAST(CASE WHEN rn <= 14 THEN 0 ELSE 1 + floor((rn - 15) / 22) END AS BIGINT) AS table_page FROM n
""")
def first_other_pages(spark, sf_dir):
    """Orders of each customer in pages of 15 then 18, and of 14 then 22."""
    rows = R.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], ["o_custkey"])
    return rows.select("o_custkey", "o_orderkey", R.page_of(F.col("rn"), 18, 15).cast("long").alias("plan_page"), R.page_of(F.col("rn"), 22, 14).cast("long").alias("table_page"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 5) AS INTEGER) AS chunk FROM orders)
SELECT o_custkey, o_orderkey, chunk FROM n QUALIFY count(*) OVER (PARTITION BY o_custkey, chunk) = 5
""")
def full_chunks_only(spark, sf_dir):
    """Orders of each customer in chunks of 5, without a last one that isn't full."""
    return R.full_chunks(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", 5, ["o_custkey"]).select("o_custkey", "o_orderkey", "chunk")


@query("""
WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, k, length(line) AS n FROM lines),
p AS (SELECT doc_id, k, CAST(0 AS INTEGER) AS page, CAST(n AS BIGINT) AS chars, 1 AS items FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN f THEN p.page + 1 ELSE p.page END, CASE WHEN f THEN s.n ELSE p.chars + s.n END, CASE WHEN f THEN 1 ELSE p.items + 1 END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.k = p.k + 1, LATERAL (SELECT (p.chars + s.n) / 90.0 >= 14 OR p.items >= 10 AS f))
SELECT doc_id, max(page) + 1 AS pages, sum(page * k)::BIGINT AS checksum FROM p GROUP BY doc_id
""")
def pack_pages(spark, sf_dir):
    """Lines of each document packed into pages by their lengths."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", R.packed_pages(sizes).alias("p"))
    check = F.aggregate(F.transform("p", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", (F.array_max("p") + 1).alias("pages"), check.alias("checksum"))


@query("SELECT p_brand, p_partkey, p_name FROM part WHERE trim(p_brand) <> '' QUALIFY row_number() OVER (PARTITION BY trim(p_brand) ORDER BY p_partkey) = 1")
def first_per_key(spark, sf_dir):
    """The first part of each brand."""
    return R.first_per_key(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


@query("""
SELECT r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS nations, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
""")
def distinct_join(spark, sf_dir):
    """The distinct nations of each region, joined in order."""
    from lumenfold.functions.nested import distinct_joined

    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = rows.groupBy("r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("x"))
    return lists.select("r_name", distinct_joined(F.col("x")).alias("nations"), F.size("x").cast("long").alias("n"))


@query("""
SELECT n_name, coalesce(string_agg(s_name || ': ' || CAST(s_suppkey AS VARCHAR), '; ' ORDER BY s_suppkey) FILTER (WHERE s_acctbal > 0), '') AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def joined_details(spark, sf_dir):
    """Suppliers of each nation as name: key, only those with a balance."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    detail = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey").cast("string"))
    return rows.groupBy("n_name").agg(R.joined_list(F.col("s_name"), detail, F.col("s_suppkey")).alias("suppliers"))


@query("""
SELECT o_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY o_orderkey) AS children, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def explode_parent(spark, sf_dir):
    """Orders with their lines as an array, exploded again with the parent's columns."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    nested = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = R.explode_children(nested, ["o_orderkey", "o_orderpriority"], "lines")
    return out.select("o_orderkey", "child.l_linenumber", "child.l_partkey", F.col("children").cast("long").alias("children"), "o_orderpriority")


@query("""
SELECT o_orderkey, l_partkey, CASE WHEN count(*) OVER (PARTITION BY o_orderkey) = 1 THEN o_orderpriority ELSE l_returnflag END AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def product_names(spark, sf_dir):
    """Lines named after their order if it has one, else after their own flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", F.col("l_returnflag").alias("description"))).alias("coverages"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.select("o_orderkey", F.array(F.struct(F.col("o_orderpriority").alias("name"), "coverages")).alias("products"))
    return R.product_coverages(nested).select("o_orderkey", F.col("coverage.l_partkey").alias("l_partkey"), "name")


@query("""
SELECT 0 AS branch, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 1, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 40
UNION ALL SELECT 2, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount = 0
""")
def rule_union(spark, sf_dir):
    """Three rules over lines, one after the other; a line may be in several."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    out = R.rule_union([lines.where(c).select(*keys) for c in ("l_returnflag = 'R'", "l_quantity >= 40", "l_discount = 0")])
    return out.select("branch", *keys)


@query("""
SELECT 'returned' AS output, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'large', count(*) FROM lineitem WHERE l_quantity >= 40 UNION ALL SELECT 'full_price', count(*) FROM lineitem WHERE l_discount = 0
""")
def multi_output(spark, sf_dir):
    """Three outputs of one pass over the lines, counted."""
    rules = {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") >= 40, "full_price": F.col("l_discount") == 0}
    return R.multi_output(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), rules).groupBy("output").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT c_nationkey, month(o_orderdate) AS m, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_nationkey, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS labels, string_agg(CAST(v AS VARCHAR), ',' ORDER BY m) AS data, max(v) AS largest FROM m GROUP BY c_nationkey
""")
def chart_series(spark, sf_dir):
    """Orders by month for each nation, as chart labels and values."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = rows.groupBy("c_nationkey", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("v"))
    out = R.chart_series(counted.withColumn("label", F.col("m").cast("string")), "c_nationkey", "m", "label", "v")
    return out.select("c_nationkey", F.array_join("labels", ",").alias("labels"), F.array_join(F.col("data").cast("array<string>"), ",").alias("data"), "largest")


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(x[1:CAST(ceil(len(x) / 2) AS INTEGER)], ',') AS left_half, array_to_string(x[CAST(ceil(len(x) / 2) AS INTEGER) + 1:], ',') AS right_half FROM l
""")
def halves(spark, sf_dir):
    """Each customer's orders in two columns, the first with the middle one."""
    from lumenfold.functions.nested import slice_halves

    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("x"))
    out = lists.select("o_custkey", slice_halves(F.col("x")).alias("h"))
    return out.select("o_custkey", F.array_join("h.left", ",").alias("left_half"), F.array_join("h.right", ",").alias("right_half"))


@query("""
SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey
""")
def sum_of_money_text(spark, sf_dir):
    """Sums of money text in Brazilian notation."""
    from lumenfold.functions.money import format_currency_br

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = rows.select("c_nationkey", format_currency_br(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    return text.groupBy("c_nationkey").agg(R.sum_br(F.col("t")).cast("double").alias("total"))
