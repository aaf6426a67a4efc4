"""Schemas and data files of a folder as a data source: a partition for a group of files, an error column instead of a job that ends, and filters on doc_id that
leave files unread.

    job_files(spark, folder, kind="xsd").where("doc_id = '7'")

Folders are of any file system that Arrow opens by URI (local paths, file, hdfs, s3, gs). A file's doc_id is the folder that it is in, behind = if there is one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lumenfold.sources.documents import DATA, SCHEMA, parsed

ENDINGS = {"xsd": (".xsd",), "data": (".json", ".xml")}
GROUP_BYTES, GROUP_FILES = 32 << 20, 10_000


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def doc_of(path: str) -> str:
    return path.rsplit("/", 2)[-2].rpartition("=")[2]


@dataclass
class Files(InputPartition):
    paths: list[str]


class JobFiles(DataSource):
    """Options: kind (xsd or data), endings (by default those of the kind), mode (permissive, or failfast), groupBytes and groupFiles."""

    @classmethod
    def name(cls) -> str:
        return "job_files"

    def schema(self) -> str:
        return f"{SCHEMA if self.options.get('kind') == 'xsd' else DATA}, error string"

    def reader(self, schema) -> DataSourceReader:
        return JobFilesReader(dict(self.options), schema)


class JobFilesReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.kind, self.path = options.get("kind", "data"), options["path"]
        if self.kind not in ENDINGS:
            raise ValueError("kind is xsd or data")
        self.endings = tuple(x.strip() for x in options["endings"].split(",")) if "endings" in options else ENDINGS[self.kind]
        self.bytes, self.files = int(options.get("groupbytes", GROUP_BYTES)), int(options.get("groupfiles", GROUP_FILES))
        self.strict, self.docs = options.get("mode", "permissive").lower() == "failfast", None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is None or f.attribute != ("doc_id",):
                yield f
                continue
            self.docs = named if self.docs is None else self.docs & named

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.endings) and not f.base_name.startswith((".", "_")))
        groups, size = [], 0
        for path, n in files:
            if self.docs is not None and doc_of(path) not in self.docs:
                continue
            if not groups or size + n > self.bytes or len(groups[-1]) >= self.files:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            try:
                rows = parsed(self.kind, doc_of(path), raw.decode("utf-8-sig"))
            except UnicodeDecodeError as e:
                rows = [(doc_of(path), *[None] * (len((SCHEMA if self.kind == "xsd" else DATA).split(", ")) - 1), f"UnicodeDecodeError: {e}")]
            if self.strict and rows and rows[0][-1]:
                raise ValueError(f"{path}: {rows[0][-1]}")
            yield from rows


def job_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a folder's files. Spark lets sources in Python take filters only if the session says so, which this does."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JobFiles)
    return spark.read.format("job_files").options(**options).load(path)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes the rows (path, content: binary) as files under a root, each by the task that has it; gives (path, bytes), lazily. A row of a task that runs again is written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _opened(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{at}/{path}") as f:
                    f.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
