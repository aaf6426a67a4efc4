"""Files that are read one by one, job folders, versions of settings, pages of long texts, and useful values at any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import nested as N
from lumenfold.functions import predicates as P
from lumenfold.operators import paging
from lumenfold.operators.written import new_path
from lumenfold.plans.registry import query, table
from lumenfold.sources import documents as D
from lumenfold.sources.job_files import job_files, write_files
from lumenfold.sources.store import KeyedStore


def _hash(c):
    return F.md5(c.cast("string"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'c.name' AS key, c_name AS value, false AS bad FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c.nation', CAST(c_nationkey AS VARCHAR), false FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'name', c_name, false FROM customer WHERE c_mktsegment = 'FURNITURE'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, true FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def files_with_errors(spark, sf_dir):
    """A data file of each customer, written and read as a data source: of two segments they are cut short or refused, and are rows with an error."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    json = F.concat(F.lit('{"c": {"name": "'), "c_name", F.lit('", "nation": '), "nation", F.lit("}}"))
    xml = F.concat(F.lit("<r><name>"), "c_name", F.lit("</name></r>"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.substr(json, F.lit(1), F.length(json) - 1)).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit('<!DOCTYPE r [<!ENTITY e "x">]>'), xml)).when(F.col("c_mktsegment") == "FURNITURE", xml).otherwise(json)
    ending = F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), "xml").otherwise("json")
    root = new_path(spark, "files")
    write_files(c.select(F.concat_ws("/", F.concat(F.lit("doc_id="), "c_custkey"), F.concat(F.lit("data."), ending)).alias("path"), text.cast("binary").alias("content")).repartition(8), root).write.format("noop").mode("overwrite").save()
    found = job_files(spark, root, kind="data", groupFiles="500")
    return found.select("doc_id", "key", "value", F.col("error").isNotNull().alias("bad"))


@query("""
SELECT md5(CAST(s_suppkey AS VARCHAR)) AS raw, 'xsd' AS kind, s_name AS content FROM supplier WHERE s_nationkey < 20
UNION ALL SELECT md5(CAST(s_suppkey AS VARCHAR)), 'data', CASE WHEN s_nationkey % 2 = 0 THEN 'json ' ELSE 'xml ' END || s_name FROM supplier WHERE s_nationkey < 20
UNION ALL SELECT md5(CAST(s_suppkey AS VARCHAR)), 'pdf', '%PDF' FROM supplier WHERE s_nationkey < 20
""")
def job_folders(spark, sf_dir):
    """A folder of each supplier with a PDF, a schema and data, written and loaded: JSON goes before XML, and folders that are no jobs are left out."""
    s = table(spark, sf_dir, "supplier")
    h = _hash(F.col("s_suppkey"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    job = F.when(F.col("s_nationkey") < 20, uuid).otherwise(F.concat(F.lit("x-"), h))
    file = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    data = F.when(F.col("s_nationkey") % 2 == 0, F.array(file("data.json", F.concat(F.lit("json "), "s_name")), file("data.xml", F.lit("not this")))).otherwise(F.array(file("data.xml", F.concat(F.lit("xml "), "s_name"))))
    every = F.concat(data, F.array(file("schema.xsd", F.col("s_name")), file("input.pdf", F.lit("%PDF")), file("notes.txt", F.lit("left out"))))
    files = s.select(h.alias("raw"), job.alias("job"), F.explode(every).alias("f")).select("raw", F.concat_ws("/", "job", "f.name").alias("path"), F.col("f.text").cast("binary").alias("content"))
    root = new_path(spark, "jobs")
    write_files(files.repartition(8), root).write.format("noop").mode("overwrite").save()
    loaded = D.load_jobs(spark, root).select("job_id", "kind", F.col("content").cast("string").alias("content"))
    return loaded.join(s.select(h.alias("raw"), uuid.alias("job_id")), "job_id").select("raw", "kind", "content")


@query("""
WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, max(c_name) AS value FROM customer GROUP BY c_nationkey), b AS (SELECT CAST(s_nationkey AS VARCHAR) AS key, max(s_name) AS value FROM supplier WHERE s_nationkey < 10 GROUP BY s_nationkey),
v2 AS (SELECT coalesce(b.key, a.key) AS key, coalesce(b.value, a.value) AS value, CAST(CASE WHEN b.key IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version FROM a FULL JOIN b ON a.key = b.key)
SELECT 1 AS as_of, key, value, CAST(1 AS BIGINT) AS version FROM a UNION ALL SELECT 2, key, value, version FROM v2 UNION ALL SELECT 3, key, value, version FROM v2 WHERE key NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)
""")
def settings_versions(spark, sf_dir):
    """Names by nation in a store: put, partly replaced, and partly removed; all three versions as they stood, then a reset."""
    pairs = lambda name, key, value: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    store = KeyedStore(spark, new_path(spark, "store"), 8)
    store.put(pairs("customer", "c_nationkey", "c_name"))
    store.put(pairs("supplier", "s_nationkey", "s_name").where("cast(key as int) < 10"))
    store.remove(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key")))
    store.reset()
    out = store.read().select(F.lit(4).alias("as_of"), "key", "value", "version")
    for v in (1, 2, 3):
        out = out.unionByName(store.read(v).select(F.lit(v).alias("as_of"), "key", "value", "version"))
    return out


@query("""
WITH RECURSIVE w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS line, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, length(line) AS size, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
k AS (SELECT *, max(i) OVER (PARTITION BY doc_id ORDER BY upto - size RANGE BETWEEN CURRENT ROW AND 1259 FOLLOWING) AS k, max(i) OVER (PARTITION BY doc_id) AS last, max(upto) OVER (PARTITION BY doc_id) AS total FROM s),
n AS (SELECT doc_id, i, least(i + 300, CASE WHEN k < last OR total - upto + size >= 1260 THEN greatest(k, i + 1) ELSE i + 300 END) AS j FROM k WHERE least(i + 300, CASE WHEN k < last OR total - upto + size >= 1260 THEN greatest(k, i + 1) ELSE i + 300 END) <= last),
r AS (SELECT doc_id, i FROM s WHERE i = 0 UNION ALL SELECT r.doc_id, n.j FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS page FROM r)
SELECT p.doc_id, CAST(page AS INTEGER) AS page, count(*) AS words, CAST(sum(size) AS BIGINT) AS letters FROM p JOIN s ON s.doc_id = p.doc_id AND s.i >= p.i AND (stop IS NULL OR s.i < stop) GROUP BY p.doc_id, page
""")
def long_text_pages(spark, sf_dir):
    """The words of whole texts on pages of fewer than 1260 letters and 300 words at most; those of very long texts are rows, so that a text may be of any length."""
    made = paging.packed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), " ", 14, 90, 300)
    return made.select("doc_id", "page", F.col("lines").alias("words"), "letters")


@query("""
WITH l AS (SELECT l_orderkey, bool_or(l_quantity > 49) AS many, bool_or(l_discount > 0.09) AS noted FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(many, false) OR coalesce(noted, false) OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' AS useful FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def useful_orders(spark, sf_dir):
    """Orders that hold anything useful at any depth: an item in a list, a note in a map within an object, or a text that isn't blank."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 49, F.col("l_linenumber"))).alias("many"), F.max(F.when(F.col("l_discount") > 0.09, "x").otherwise(" ")).alias("note"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = lambda test, yes: F.when(test, yes).otherwise("  ")
    deep = F.struct(F.struct(F.create_map(F.lit("note"), F.coalesce("note", F.lit(""))).alias("notes"), F.struct(text(F.col("o_orderstatus") == "P", "p").alias("status")).alias("inner")).alias("a"), F.coalesce("many", F.array().cast("array<int>")).alias("many"), text(F.col("o_orderpriority") == "1-URGENT", "u").alias("priority"))
    nested = rows.select("o_orderkey", deep.alias("deep"))
    return nested.select("o_orderkey", N.useful_within(F.col("deep"), nested.schema["deep"].dataType).alias("useful"))


@query("""
SELECT page_id, array_to_string([x FOR x IN [CASE WHEN url LIKE 'http://%' THEN 'PDF vazio.' END, CASE WHEN contains(url, '?') OR contains(url, '#') THEN 'Arquivo XSD invalido.' END, CASE WHEN NOT lower(url) LIKE '%.html' THEN 'Arquivo de dados deve ser JSON ou XML.' END] IF x IS NOT NULL], ',') AS problems FROM pages
""")
def file_divergences(spark, sf_dir):
    """What is wrong with sets of files that pages stand for: an empty PDF, a schema of another ending, data of another kind."""
    url = F.col("url")
    schema = F.when(F.contains(url, F.lit("?")) | F.contains(url, F.lit("#")), "a.txt").otherwise("a.XSD")
    found = P.file_divergences(F.when(url.startswith("http://"), 0).otherwise(1), schema, F.when(F.lower("url").endswith(".html"), "x.xml").otherwise(F.lit("x.txt")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("problems"))
