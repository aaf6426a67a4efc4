"""Readers of page blocks, schemas and data files; all parse on the executors."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.nested import _leaves, flatten_json
from lumenfold.functions.predicates import UUID4

BLOCKS = "doc_id string, block_idx long, text string, x double, y double, width double, height double, page int, font_size double, font_name string, block_type string"
SCHEMA = "doc_id string, field_idx long, name string, type string, min_occurs string, max_occurs string, description string"
DATA = "doc_id string, key_idx long, key string, value string"


def _rows(schema: str, work: Callable[[str, object], Iterator[tuple]]) -> Callable:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(work(doc, content))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def _secure(text: str) -> ET.Element:
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        raise ValueError("XML with a document type or entities is refused")
    return ET.fromstring(text)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def schema_rows(doc: str, text: str | None) -> Iterator[tuple]:
    """Named elements of a schema in document order, with defaults for type and occurrences; not those of another namespace than the schema's own."""
    k, root = 0, _secure(text) if text and text.strip() else None
    for e in root.iter() if root is not None else ():
        if e.tag != root.tag.removesuffix(_local(root.tag)) + "element" or not e.get("name"):
            continue
        said = next((d.text or "" for a in e if _local(a.tag) == "annotation" for d in a if _local(d.tag) == "documentation"), "")
        yield doc, k, e.get("name"), _local(e.get("type") or "xs:string"), e.get("minOccurs") or "1", e.get("maxOccurs") or "1", said.strip()
        k += 1


def xml_rows(doc: str, text: str | None) -> Iterator[tuple]:
    """The text of each element by its tag, blank ones left out; the last of equal tags counts, at the first one's place."""
    found: dict[str, str] = {}
    for e in _secure(text).iter() if text and text.strip() else ():
        if isinstance(e.tag, str) and e.text and e.text.strip():
            found[_local(e.tag)] = e.text.strip()
    for k, (key, value) in enumerate(found.items()):
        yield doc, k, key, value


def parsed(kind: str, doc: str, text: str | None) -> list[tuple]:
    """The rows of a file (kind: xsd or data) with a null error; of one that can't be read a single row with nothing but its doc_id and what is wrong."""
    try:
        return [(*row, None) for row in (schema_rows if kind == "xsd" else data_rows)(doc, text)]
    except (ValueError, ET.ParseError, RecursionError) as e:
        width = len((SCHEMA if kind == "xsd" else DATA).split(", ")) - 1
        return [(doc, *[None] * width, f"{type(e).__name__}: {e}")]


def data_rows(doc: str, text: str | None) -> Iterator[tuple]:
    """The leaves of JSON if the text begins with { or [, else the elements of XML."""
    text = (text or "").strip()
    if not text.startswith(("{", "[")):
        yield from xml_rows(doc, text)
        return
    for k, (key, value) in enumerate(dict(_leaves(json.loads(text), "")).items()):
        yield doc, k, key, value


def schema_fields(files: DataFrame, keep_bad: bool = False) -> DataFrame:
    """schema_fields of (doc_id, content) rows of schema text. keep_bad: a bad file is a row with an error, and doesn't end the job."""
    if keep_bad:
        return files.select("doc_id", "content").mapInArrow(_rows(f"{SCHEMA}, error string", lambda doc, text: parsed("xsd", doc, text)), f"{SCHEMA}, error string")
    return files.select("doc_id", "content").mapInArrow(_rows(SCHEMA, schema_rows), SCHEMA)


def data_fields(files: DataFrame, keep_bad: bool = False) -> DataFrame:
    """data_fields of (doc_id, content) rows: JSON if the text begins with { or [, else XML. Text that is neither fails, or with keep_bad is a row with an error."""
    if keep_bad:
        return files.select("doc_id", "content").mapInArrow(_rows(f"{DATA}, error string", lambda doc, text: parsed("data", doc, text)), f"{DATA}, error string")
    json_like = F.ltrim("content").rlike(r"^[{\[]")
    flat = files.where(json_like).select("doc_id", F.coalesce(flatten_json(F.col("content")), F.raise_error(F.lit("invalid JSON")).cast("array<struct<idx:long,path:string,value:string>>")).alias("x"))
    of_json = flat.select("doc_id", F.inline("x")).toDF("doc_id", "key_idx", "key", "value")
    return of_json.unionByName(files.where(~json_like).select("doc_id", "content").mapInArrow(_rows(DATA, xml_rows), DATA))


def blocks_from_pdf(files: DataFrame) -> DataFrame:
    """blocks of (doc_id, content) rows of PDF bytes; needs pdfplumber on the executors.

    Per page its words with positions as shares of the page, then its tables: cells joined by ' | ', rows by line feeds, blank ones left out.
    """

    def read(doc: str, content: bytes) -> Iterator[tuple]:
        import io

        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF needs pdfplumber") from e
        k = 0
        try:
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                for number, page in enumerate(pdf.pages, 1):
                    w, h = float(page.width or 1), float(page.height or 1)
                    for x in page.extract_words(extra_attrs=["size", "fontname"]):
                        yield doc, k, x["text"], x["x0"] / w, x["top"] / h, (x["x1"] - x["x0"]) / w, (x["bottom"] - x["top"]) / h, number, float(x.get("size") or 0), x.get("fontname") or "", "text"
                        k += 1
                    for table in page.extract_tables():
                        text = table_text(table)
                        if text.strip():
                            yield doc, k, text, 0.0, 0.0, 1.0, 0.1, number, 0.0, "", "table"
                            k += 1
        except Exception as e:
            raise ValueError(f"Erro ao extrair PDF: {e}") from e

    return files.select("doc_id", "content").mapInArrow(_rows(BLOCKS, read), BLOCKS)


def table_text(table: list[list[str | None]]) -> str:
    """Cells joined by ' | ', rows by line feeds; rows that are null or empty are left out."""
    return "\n".join(" | ".join(cell or "" for cell in row) for row in table if row)


def tables_to_blocks(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table, text) of (doc_id, page, table, row, cells: array of strings) rows; a null cell is empty, null and empty rows and blank tables are left out."""
    rows = cells.where(F.size("cells") > 0).select("doc_id", "page", "table", "row", F.array_join(F.col("cells"), " | ", "").alias("line"))
    made = rows.groupBy("doc_id", "page", "table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return made.where(F.regexp_replace("text", r"\s", "") != "")


def template_data(files: DataFrame) -> DataFrame:
    """(doc_id, json) of (doc_id, content) rows: `var data = {...};` or plain JSON, without comments and trailing commas; null if still no JSON."""
    text = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r"(?m)^\s*//.*$", "")
    text = F.regexp_replace(text, r"(?s)^\s*var\s+\w+\s*=\s*(.*?);?\s*$", "$1")
    text = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    return files.select("doc_id", F.when(F.try_parse_json(text).isNotNull(), F.trim(text)).alias("json"))


def schema_counters(content: Column) -> Column:
    """(elements, optional) counted in schema text."""
    return F.struct(F.regexp_count(content, F.lit(r"<xs:element\b")).alias("elements"), F.regexp_count(content, F.lit(r'minOccurs="0"')).alias("optional"))


def top_level_keys(content: Column) -> Column:
    """Keys of a JSON object; 0 for anything else."""
    return F.greatest(F.coalesce(F.size(F.json_object_keys(content)), F.lit(0)), F.lit(0))


def load_jobs(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, kind, path, content) of the folders of a root: input.pdf, schema.xsd, and data.json rather than data.xml.

    Folders whose names are no version 4 UUIDs are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content").where(F.col("job_id").rlike(UUID4))
    kind = F.when(F.col("name") == "input.pdf", "pdf").when(F.col("name") == "schema.xsd", "xsd").when(F.col("name").isin("data.json", "data.xml"), "data")
    return parts.withColumn("kind", kind).where("kind is not null").groupBy("job_id", "kind").agg(F.min_by(F.struct("path", "content"), "name").alias("f")).select("job_id", "kind", "f.*")


VERSION = "1.0"


def open_project(text: str) -> dict:
    """A saved project; only of this version."""
    project = json.loads(text)
    if project.get("version") != VERSION:
        raise ValueError("unknown project version")
    return project


def save_project(project: dict) -> str:
    return json.dumps({"version": VERSION, **project}, ensure_ascii=False, indent=2)


def open_projects(files: DataFrame) -> DataFrame:
    """(doc_id, project, opened) of (doc_id, content) rows: the JSON of projects of this version, null for others."""
    opened = F.coalesce(F.get_json_object("content", "$.version") == VERSION, F.lit(False))
    return files.select("doc_id", F.when(opened, F.col("content")).alias("project"), opened.alias("opened"))


def save_projects(df: DataFrame, key: str) -> DataFrame:
    """(doc_id, content): each row's other columns as a project of this version."""
    rest = [F.col(c) for c in df.columns if c != key]
    return df.select(F.col(key).alias("doc_id"), F.to_json(F.struct(F.lit(VERSION).alias("version"), *rest)).alias("content"))
