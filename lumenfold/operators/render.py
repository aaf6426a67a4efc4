"""Template text from blocks and mappings, preview and bundle."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.money import percent_position
from lumenfold.functions.text import escape_html, escape_js, sanitize_identifier

# The three rules of every style sheet.
CSS = "\n".join([
    "#form-container { position: relative; width: 100%; min-height: 1123px; }",
    ".label { position: absolute; font-size: 12px; color: #333; }",
    ".field { position: absolute; font-size: 12px; color: #000; border-bottom: 1px solid #999; min-width: 80px; }",
])


# The skeletons of spans and scripts below.
def span(field: Column, text: Column, x: Column, y: Column) -> Column:
    """A positioned span: bound to its field, or with the escaped text if the field is null."""
    place = F.concat(F.lit("left:"), percent_position(x), F.lit("%;top:"), percent_position(y), F.lit("%;"))
    bound = F.concat(F.lit('<span class="field" style="'), place, F.lit('" data-bind="text: '), sanitize_identifier(field), F.lit('"></span>'))
    label = F.concat(F.lit('<span class="label" style="'), place, F.lit('">'), escape_html(F.trim(text)), F.lit("</span>"))
    return F.when(field.isNotNull(), bound).otherwise(label)


def html(blocks: DataFrame) -> DataFrame:
    """(doc_id, html): the spans of each document's blocks (with field) in order; a document's blocks are few."""
    spans = blocks.select("doc_id", "block_idx", span(F.col("field"), F.col("text"), F.col("x"), F.col("y")).alias("s"))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "s"))), lambda v: v["s"]), "\n").alias("html"))


def scripts(mappings: DataFrame, valid: bool = False) -> DataFrame:
    """(doc_id, js, example): a view model with an observable for each field, and an object of the fields' texts.

    The members are lines of the form name: value inside a function, which don't run; valid writes them as statements.
    """
    name = sanitize_identifier(F.col("jsonPath"))
    shown = escape_js(F.col("pdfText"))
    start, end = ("  self.", " = ko.observable('"), "');"
    if not valid:
        start, end = ("  ", ": ko.observable('"), "'),"
    member = F.concat(F.lit(start[0]), name, F.lit(start[1]), shown, F.lit(end))
    pair = F.concat(F.lit('"'), name, F.lit('": "'), shown, F.lit('"'))
    rows = mappings.select("doc_id", F.struct("part", "ord", member.alias("m"), pair.alias("p")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    joined = lambda k, by: F.array_join(F.transform("r", lambda x: x[k]), by)
    head = "var ViewModel = function() {\n" + "  var self = this;\n" * valid
    return rows.select(
        "doc_id",
        F.concat(F.lit(head), joined("m", "\n"), F.lit("\n};\nko.applyBindings(new ViewModel());")).alias("js"),
        F.concat(F.lit("var exampleData = {"), joined("p", ", "), F.lit("};")).alias("example"),
    )


# Fixed value: the base document.
FALLBACK = "<!DOCTYPE html><html><head><style>{styles}</style></head><body>{content}<script>{js}</script></body></html>"


def preview(content: Column, css: Column, js: Column, example: Column, base: str | None = None) -> Column:
    """The base document with {styles}, {content} and {js} filled in this order; the example comes before the script."""
    out = F.lit(base or FALLBACK)
    for mark, value in (("{styles}", css), ("{content}", content), ("{js}", F.concat(F.coalesce(example, F.lit("")), F.lit("\n"), js))):
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return out


def bundle(html: str | None, css: str | None, js: str | None, example: str | None) -> bytes:
    """A ZIP of one result."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("index.html", html or "<!-- template vazio -->"), ("css/style.css", css or ""), ("js/base.js", js or ""), ("exemplo.js", example or "")):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def bundles(results: DataFrame) -> DataFrame:
    """(doc_id, bundle) from (doc_id, html, css, js, example), zipped on the executors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            made = [bundle(r["html"], r["css"], r["js"], r["example"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "bundle"])

    rows = results.select("doc_id", "html", "css", "js", "example")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bundle binary")


def unbundled(bundles: DataFrame) -> DataFrame:
    """(doc_id, name, body) of each file in (doc_id, bundle) rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for key, data in zip(b.column("doc_id").to_pylist(), b.column("bundle").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(names), b.schema.field("doc_id").type), pa.array(names), pa.array([z.read(n) for n in names], pa.binary())], ["doc_id", "name", "body"])

    return bundles.select("doc_id", "bundle").mapInArrow(run, f"doc_id {bundles.schema['doc_id'].dataType.simpleString()}, name string, body binary")


def bind_template(template: Column, data: Column, mark: str = "##TEMPLATE_DATA##") -> Column:
    return F.replace(template, F.lit(mark), data)
