"""Matching by names, cross-validation, scores and rendered text. A document here is a brand, with its parts' name words as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.money import round_even
from lumenfold.operators import match as J
from lumenfold.operators import render, score
from lumenfold.operators.written import saved
from lumenfold.plans.registry import query, table

_BLOCKS = "SELECT p_brand AS doc_id, p_partkey * 10 + k AS block_idx, string_split(p_name, ' ')[k + 1] AS text, p_size / 50.0 AS x, (p_partkey % 100) / 100.0 AS y FROM part, LATERAL (SELECT unnest(range(0, len(string_split(p_name, ' ')))) AS k)"
_FIELDS = "SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) - 1 AS field_idx FROM (SELECT DISTINCT p_brand AS doc_id, lower(p_type) AS name FROM part UNION SELECT p_brand, lower(string_split(p_name, ' ')[1]) FROM part)"
_KEYS = "SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS key_idx FROM (SELECT DISTINCT p_brand AS doc_id, string_split(p_name, ' ')[1] AS key FROM part WHERE p_size > 25 UNION SELECT p_brand, lower(p_type) FROM part WHERE p_size > 40)"
_BEST = f"""b AS ({_BLOCKS}), f AS ({_FIELDS}), k AS ({_KEYS}),
c AS (SELECT f.doc_id, f.field_idx, f.name, b.block_idx, b.text, CASE WHEN b.text = f.name THEN 1.0::DOUBLE WHEN (contains(b.text, f.name) OR contains(f.name, b.text)) AND 1 - levenshtein(b.text, f.name) / greatest(length(b.text), length(f.name)) < 0.75 THEN 0.75
  ELSE 1 - levenshtein(b.text, f.name) / greatest(length(b.text), length(f.name)) END AS conf FROM f JOIN b ON b.doc_id = f.doc_id),
best AS (SELECT doc_id, field_idx, name, text, block_idx, conf FROM c WHERE conf > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, field_idx ORDER BY conf DESC, block_idx) = 1)"""
_MAPPED = f"""{_BEST},
m AS (SELECT f.doc_id, 0 AS part, f.field_idx AS ord, coalesce(best.text, '') AS pdfText, f.name AS jsonPath, coalesce(conf, 0) AS conf, k.key IS NULL AS missing, coalesce(k.key_idx, -1) AS kidx
  FROM f LEFT JOIN best USING (doc_id, field_idx) LEFT JOIN k ON k.doc_id = f.doc_id AND k.key = f.name),
a AS (SELECT doc_id, part, ord, pdfText, jsonPath, CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN missing AND doc_id IN (SELECT doc_id FROM k) THEN 'not_found' WHEN conf >= 0.8 THEN 'ok' WHEN conf >= 0.5 THEN 'ambiguous' ELSE 'not_found' END AS status, round_even(conf, 4) AS raw_confidence,
  CASE WHEN kidx >= 0 THEN CAST(kidx AS VARCHAR) ELSE '' END AS data_value, pdfText AS normalized_value FROM m
  UNION ALL SELECT doc_id, 1, key_idx, '', key, 'low', 'optional', 0, CAST(key_idx AS VARCHAR), '' FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.name = k.key))"""


def _inputs(spark, sf_dir):
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_size", F.posexplode(F.split("p_name", " ")).alias("k", "text"))
    blocks = words.select("doc_id", (F.col("p_partkey") * 10 + F.col("k")).alias("block_idx"), "text", (F.col("p_size") / 50.0).alias("x"), (F.col("p_partkey") % 100 / 100.0).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"), F.lit(1).alias("page"))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    names = part.select(F.col("p_brand").alias("doc_id"), F.lower("p_type").alias("name")).union(part.select("p_brand", F.lower(first))).distinct()
    rank = lambda c: (F.row_number().over(Window.partitionBy("doc_id").orderBy(c)) - 1).cast("long")
    schema = names.withColumn("field_idx", rank("name")).withColumn("type", F.lit("string"))
    keys = part.where("p_size > 25").select(F.col("p_brand").alias("doc_id"), first.alias("key")).union(part.where("p_size > 40").select("p_brand", F.lower("p_type"))).distinct()
    data = keys.withColumn("key_idx", rank("key")).withColumn("value", F.col("key_idx").cast("string"))
    return blocks, schema, data


def _mapped(spark, sf_dir):
    return J.match_fields(*_inputs(spark, sf_dir))


@query(f"WITH {_BEST} SELECT doc_id, field_idx, round_even(conf, 4) AS confidence, block_idx FROM best")
def best_match(spark, sf_dir):
    """Each field's best block."""
    blocks, schema, _ = _inputs(spark, sf_dir)
    norm = J.normalize_name
    best = J.best_blocks(schema.select("doc_id", "field_idx", norm(F.col("name")).alias("norm")), blocks.select("doc_id", "block_idx", norm(F.col("text")).alias("norm")))
    return best.select("doc_id", "field_idx", round_even(F.col("confidence"), 4).alias("confidence"), "block_idx")


@query(f"WITH {_MAPPED} SELECT doc_id, part, ord, pdfText, jsonPath, confidence, status, raw_confidence, data_value, normalized_value FROM a")
def field_match(spark, sf_dir):
    """All mappings: schema fields with blocks and values, then keys that the schema lacks."""
    return _mapped(spark, sf_dir).select("doc_id", "part", "ord", "pdfText", "jsonPath", "confidence", "status", "raw_confidence", "data_value", "normalized_value")


@query(f"""
WITH {_BEST} SELECT f.doc_id, 'no data' AS given, 0 AS part, f.field_idx AS ord, f.name AS jsonPath, CASE WHEN conf >= 0.8 THEN 'ok' WHEN conf >= 0.5 THEN 'ambiguous' ELSE 'not_found' END AS status FROM f LEFT JOIN best USING (doc_id, field_idx)
UNION ALL SELECT doc_id, 'no schema', 1, key_idx, key, 'optional' FROM k
""")
def match_of_parts(spark, sf_dir):
    """Mappings where documents have no data, so that nothing is missing from it, and where they have no schema, so that all keys are optional."""
    blocks, schema, data = _inputs(spark, sf_dir)
    told = lambda df, given: df.select("doc_id", F.lit(given).alias("given"), "part", "ord", "jsonPath", "status")
    return told(J.match_fields(blocks, schema, data.limit(0)), "no data").unionByName(told(J.match_fields(blocks, schema.limit(0), data), "no schema"))


@query(f"WITH {_MAPPED} SELECT doc_id, part, ord, CASE WHEN part = 0 AND ord = 0 THEN 'edited' ELSE jsonPath END AS jsonPath, part = 0 AND ord = 0 AS isManual, CASE WHEN part = 0 AND ord = 0 THEN 'ok' ELSE status END AS status FROM a")
def manual_edits(spark, sf_dir):
    """Mappings after each document's first field was edited."""
    mapped = saved(_mapped(spark, sf_dir), "mappings")
    edits = mapped.where("part = 0 and ord = 0").select("id", F.lit("edited").alias("path"))
    return J.edit_mappings(mapped, edits).select("doc_id", "part", "ord", "jsonPath", "isManual", "status")


@query(f"WITH b AS ({_BLOCKS}), f AS ({_FIELDS}), k AS ({_KEYS}) SELECT doc_id, name, 'missing_in_data' AS problem FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND k.key = f.name) UNION ALL SELECT doc_id, key, 'missing_in_schema' FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.name = k.key)")
def cross_validate(spark, sf_dir):
    """What schema and data lack of each other."""
    _, schema, data = _inputs(spark, sf_dir)
    return J.cross_validate(schema, data)


@query(f"WITH {_MAPPED} SELECT doc_id, count(*) AS fields, count(*) FILTER (WHERE confidence = 'high') AS high, round_even(count(*) FILTER (WHERE confidence = 'high')::DOUBLE / count(*) * 100, 1) AS score, count(*) - count(*) FILTER (WHERE confidence = 'high') AS review FROM a GROUP BY doc_id")
def fidelity_score(spark, sf_dir):
    """Share of high confidences of each document."""
    return score.fidelity(_mapped(spark, sf_dir), ["doc_id"]).select("doc_id", "fields", "high", "score", "review")


@query(f"WITH {_MAPPED} SELECT doc_id, jsonPath, 'Campo ''' || jsonPath || ''' com baixa confiança de mapeamento (raw: ' || format('{{:.2f}}', CAST(raw_confidence AS DOUBLE)) || '). Verificar manualmente.' AS message FROM a WHERE confidence = 'low'")
def low_confidence_suggestions(spark, sf_dir):
    """A warning for each mapping of low confidence."""
    return score.suggestions(_mapped(spark, sf_dir)).select("doc_id", "jsonPath", "message")


@query(f"""
WITH b AS ({_BLOCKS}), p AS (SELECT doc_id, field_idx AS ord, name AS path FROM ({_FIELDS})),
r AS (SELECT b.doc_id, b.block_idx, coalesce(max(CASE WHEN b.text = p.path THEN p.path END), arg_min(p.path, p.ord) FILTER (WHERE contains(b.text, p.path))) AS field FROM b LEFT JOIN p ON p.doc_id = b.doc_id GROUP BY ALL),
s AS (SELECT doc_id, block_idx, CASE WHEN field IS NOT NULL THEN '<span class="field" style="left:' || format('{{:.1f}}', CAST(x * 100 AS DOUBLE)) || '%;top:' || format('{{:.1f}}', CAST(y * 100 AS DOUBLE)) || '%;" data-bind="text: ' || field || '"></span>'
  ELSE '<span class="label" style="left:' || format('{{:.1f}}', CAST(x * 100 AS DOUBLE)) || '%;top:' || format('{{:.1f}}', CAST(y * 100 AS DOUBLE)) || '%;">' || text || '</span>' END AS s FROM b JOIN r USING (doc_id, block_idx))
SELECT doc_id, count(*) AS spans, md5(string_agg(s, chr(10) ORDER BY block_idx)) AS html_md5 FROM s GROUP BY doc_id
""")
def html_spans(spark, sf_dir):
    """Each document's blocks as positioned spans."""
    blocks, schema, _ = _inputs(spark, sf_dir)
    bound = J.fields_of_blocks(blocks, schema.select("doc_id", F.col("field_idx").alias("ord"), F.col("name").alias("path")))
    made = render.html(bound)
    return made.select("doc_id", F.size(F.split("html", "\n")).cast("long").alias("spans"), F.md5("html").alias("html_md5"))


@query(f"""
WITH {_MAPPED} SELECT doc_id, md5('var ViewModel = function() {{' || chr(10) || string_agg('  ' || jsonPath || ': ko.observable(''' || pdfText || '''),', chr(10) ORDER BY part, ord) || chr(10) || '}};' || chr(10) || 'ko.applyBindings(new ViewModel());') AS js_md5,
  md5('var exampleData = {{' || string_agg('"' || jsonPath || '": "' || pdfText || '"', ', ' ORDER BY part, ord) || '}};') AS example_md5 FROM a GROUP BY doc_id
""")
def view_models(spark, sf_dir):
    """Each document's view model and example."""
    return render.scripts(_mapped(spark, sf_dir)).select("doc_id", F.md5("js").alias("js_md5"), F.md5("example").alias("example_md5"))


@query("""
SELECT page_id, md5('<!DOCTYPE html><html><head><style>' || 'a{}' || '</style></head><body>' || replace(replace(html, '{styles}', '{styles}'), '{js}', coalesce('var x;', '') || chr(10) || url) || '<script>' || 'var x;' || chr(10) || url || '</script></body></html>') AS preview_md5 FROM pages
""")
def previews(spark, sf_dir):
    """Whole pages put into the base document."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(render.preview(F.col("html"), F.lit("a{}"), F.col("url"), F.lit("var x;"))).alias("preview_md5"))
