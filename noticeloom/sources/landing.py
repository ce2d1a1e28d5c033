"""The `landing` data source: a folder of fetched files as raw pages, in batches and as a stream.

Files lie under `<path>/<source_code>/list/<list_key>-<page_no>.<suffix>` and `<path>/<source_code>/detail/<key>.<suffix>`; others are
left out. Paths may be in any store that Arrow's file systems know. Files are dealt into groups of about `groupBytes`, each a partition that is
read where it runs; the driver sees names and sizes only. Bytes that are no UTF-8 become the replacement character.

    register_landing(spark)
    pages = spark.read.format("landing").option("path", folder).option("source", "KANC").load()
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RAW_PAGES = "source_code string, page_kind string, list_key string, page_no int, key string, url string, body string, fetched_at timestamp"
GROUP_BYTES = 64 << 20
NAME = re.compile(r"/([^/]+)/(?:(list)/([^/]+)-(\d{1,9})|(detail)/([^/]+?))(?:\.[^./]*)?$")


@dataclass
class FileGroup(InputPartition):
    """Files that one task reads: (path, time in nanoseconds)."""

    root: str
    files: list[tuple[str, int]]


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _listed(root: str, source: str | None) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the files that are pages, oldest first."""
    store, path = _store(root)
    found = store.get_file_info(fs.FileSelector(f"{path}/{source}" if source else path, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == fs.FileType.File and NAME.search(f.path) and not re.search(r"/[._][^/]*$", f.path))


def _grouped(root: str, files: list[tuple[int, str, int]], group_bytes: int) -> list[FileGroup]:
    groups, size = [], group_bytes
    for time, path, n in files:
        if size + n > group_bytes:
            groups.append(FileGroup(root, []))
            size = 0
        groups[-1].files.append((path, time))
        size += n
    return groups


def _pages(group: FileGroup) -> Iterator[pa.RecordBatch]:
    """One batch a file, so that a task holds one page at a time."""
    store, _ = _store(group.root)
    for path, time in group.files:
        source, is_list, list_key, page_no, is_detail, key = NAME.search(path).groups()
        with store.open_input_stream(path) as file:
            body = file.read().decode("utf-8", "replace")
        when = datetime.datetime.fromtimestamp(time // 1_000_000_000, datetime.UTC).replace(microsecond=time // 1000 % 1_000_000)
        row = [source, is_list or is_detail, list_key, int(page_no) if page_no else None, key, path, body]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], kind) for x, kind in zip(row, kinds)), pa.array([when], pa.timestamp("us", "UTC"))], [c.split()[0] for c in RAW_PAGES.split(", ")])


class LandingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.source, self.group_bytes = options["path"].rstrip("/"), options.get("source"), int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[FileGroup]:
        return _grouped(self.root, _listed(self.root, self.source), self.group_bytes) or [FileGroup(self.root, [])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return _pages(partition)


class LandingStream(DataSourceStreamReader):
    """Offsets are the time and path of the last file taken. A file has to appear under its name with the time of its arrival, later than those before it."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.source, self.group_bytes = options["path"].rstrip("/"), options.get("source"), int(options.get("groupbytes", GROUP_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.root, self.source)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FileGroup]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return _grouped(self.root, [f for f in _listed(self.root, self.source) if after < f[:2] <= upto], self.group_bytes)

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return _pages(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: landed files stay."""


class LandingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return RAW_PAGES

    def reader(self, schema: StructType) -> LandingReader:
        return LandingReader(self.options)

    def streamReader(self, schema: StructType) -> LandingStream:  # noqa: N802
        return LandingStream(self.options)


def land(pages: DataFrame, root: str) -> None:
    """Puts pages (source_code, page_kind, list_key, page_no, key, body) where the source finds them, each task its own: what a fetcher does."""

    def put(rows: Iterator) -> None:
        store, path = _store(root)
        for r in rows:
            name = f"{r.list_key}-{r.page_no}" if r.page_kind == "list" else r.key
            folder = f"{path}/{r.source_code}/{r.page_kind}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/.{name}.part") as file:
                file.write(r.body.encode())
            store.move(f"{folder}/.{name}.part", f"{folder}/{name}.html")

    pages.where("body is not null").foreachPartition(put)


def register_landing(spark: SparkSession) -> None:
    spark.dataSource.register(LandingSource)


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list pages and the detail pages of raw pages, as profiles take them."""
    return pages.where("page_kind = 'list'").select("list_key", "page_no", "body"), pages.where("page_kind = 'detail'").select("key", "body")
