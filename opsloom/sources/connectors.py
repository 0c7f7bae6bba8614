"""Connectors as Python data sources: records that come in pages, and bundles of files.

`opsloom_pages` reads pages of JSON lines under <path>/<column>=<value>/.../; each page is a task of its own, and equality
filters on the columns that name the folders choose pages before any is opened. `opsloom_bundle` writes files (name, content)
under a folder; tasks write to folders of their own and list what they wrote, with size and digest, in a part of the
manifest; the bundle's manifest names the parts, and is written once all tasks are done. A task that fails, or runs twice,
leaves nothing that the manifest names."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PAGE_ROWS = 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# Pages


@dataclass
class Page(InputPartition):
    path: str
    fixed: tuple[tuple[str, str], ...]


class PagedSource(DataSource):
    """Options: path, and by, the columns that name the folders, with commas between."""

    @classmethod
    def name(cls) -> str:
        return "opsloom_pages"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], self.options["by"].split(","), schema)


class PagedReader(DataSourceReader):
    def __init__(self, path: str, by: list[str], schema: StructType):
        self.path, self.by, self.schema = path, by, schema
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take equalities on the folders' columns; give the others back."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.by:
                yield f
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Page]:
        files, root = _open(self.path)
        folders, pages = [(root, ())], []
        for column in self.by:
            below = []
            for folder, fixed in folders:
                for entry in files.get_file_info(fs.FileSelector(folder)):
                    name, _, value = entry.base_name.partition("=")
                    if entry.type == fs.FileType.Directory and name == column and value in self.wanted.get(column, {value}):
                        below.append((entry.path, (*fixed, (name, value))))
            folders = below
        for folder, fixed in folders:
            pages += [Page(entry.path, fixed) for entry in files.get_file_info(fs.FileSelector(folder)) if entry.is_file and entry.base_name.endswith(".json")]
        return sorted(pages, key=lambda p: p.path) or [Page("", ())]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = _open(self.path)
        fixed = dict(partition.fixed)
        with files.open_input_stream(partition.path) as page:
            for line in page.read().splitlines():
                row = json.loads(line) | fixed
                yield tuple(row.get(c) for c in self.schema.names)


def write_pages(rows: DataFrame, path: str, by: list[str], size: int = PAGE_ROWS) -> None:
    """Rows as pages of a size, in folders by these columns."""
    rows.write.option("maxRecordsPerFile", size).partitionBy(*by).json(path)


def read_pages(spark: SparkSession, path: str, by: list[str], schema: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("opsloom_pages").option("path", path).option("by", ",".join(by)).schema(schema).load()


# Bundles


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: a folder, and how many files."""

    name: str
    files: int


class BundleSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opsloom_bundle"

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = _open(self.path)
        name, n = uuid.uuid4().hex, 0
        files.create_dir(f"{root}/files/{name}")
        files.create_dir(f"{root}/parts")
        try:
            with files.open_output_stream(f"{root}/parts/{name}.json") as part:
                for batch in iterator:
                    for file, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                        content = content or b""
                        with files.open_output_stream(f"{root}/files/{name}/{n}") as out:
                            out.write(content)
                        said = {"name": file, "path": f"files/{name}/{n}", "size": len(content), "sha256": hashlib.sha256(content).hexdigest()}
                        part.write(json.dumps(said).encode() + b"\n")
                        n += 1
        except BaseException:
            self._drop(name)
            raise
        return Part(name, n)

    def _drop(self, name: str) -> None:
        files, root = _open(self.path)
        files.delete_dir(f"{root}/files/{name}")
        if files.get_file_info(f"{root}/parts/{name}.json").type != fs.FileType.NotFound:
            files.delete_file(f"{root}/parts/{name}.json")

    def commit(self, messages: list[Part | None]) -> None:
        """The manifest has a line for each task."""
        files, root = _open(self.path)
        with files.open_output_stream(f"{root}/manifest.draft") as out:
            for part in messages:
                if part is not None:
                    out.write(json.dumps({"part": part.name, "files": part.files}).encode() + b"\n")
        files.move(f"{root}/manifest.draft", f"{root}/manifest.json")

    def abort(self, messages: list[Part | None]) -> None:
        for part in messages:
            if part is not None:
                self._drop(part.name)


def write_bundle(files: DataFrame, path: str) -> None:
    """Write rows (name, content) as files of a bundle."""
    files.sparkSession.dataSource.register(BundleSink)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("opsloom_bundle").option("path", path).mode("append").save()


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size, sha256) of the files of a bundle that was finished."""
    finished = spark.read.schema("part string, files long").json(f"{path}/manifest.json")
    listed = spark.read.schema("name string, path string, size long, sha256 string").json(f"{path}/parts")
    return listed.withColumn("part", F.split("path", "/")[1]).join(finished.select("part"), "part", "left_semi").select("name", "path", "size", "sha256")
