"""A paged listing as a Spark data source, for batches and for streams.

Pages are JSON-lines files ``page-000001.jsonl`` of a folder, as a collector
stores the answers of a paged interface, in any file system that Arrow knows
(local, hdfs://, s3://, gs://).  A batch read has one partition a page; a
stream's offset is the number of pages read, so a restarted query goes on where
its checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE_SCHEMA = "page int, position int, id string, url string, title string"


def _opened(path: str) -> tuple:
    """The file system of a folder and the folder's name in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[int]:
    import re

    from pyarrow import fs

    files, folder = _opened(path)
    names = [x.base_name for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"page-(\d+)\.jsonl", n)))


def _rows(path: str, page: int) -> Iterator[tuple]:
    import json

    import io

    files, folder = _opened(path)
    with files.open_input_stream(f"{folder}/page-{page:06d}.jsonl") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="\n") as f:
        for position, line in enumerate(f):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                yield page, position, row.get("id"), row.get("url"), row.get("title")


class _Page(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in _pages(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(self.path, partition.page)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(_pages(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p) for p in _pages(self.path)[start["pages"] : end["pages"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(self.path, partition.page)


class PagedSource(DataSource):
    """``spark.read.format("paged").load(folder)`` and ``spark.readStream...``; the folder must be shared."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
