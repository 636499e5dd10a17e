"""A listing of files as a Python data source, `veldspar_files`, for batches and streams.

    listed(spark, folder).where("extension = 'csv'")
    spark.readStream.format("veldspar_files").option("path", folder).load()

Rows are (path, folder, name, extension, category, size, modified). Every folder right below the root is a partition, and so are the files of the
root itself, so large trees are listed by many tasks. Filters on folder, extension and category that compare with a value are
pushed down: partitions of other folders are not listed. As a stream the source gives files that are new by time and name since the offset
before; one that changes comes again. Hidden files (a dot or an underscore in front) are left out, as Spark does.

Folders are listed by pyarrow's file systems, in Python, so they have to be local, shared, or of a kind that those connect to.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from veldspar.functions import constants as K

SCHEMA = "path string, folder string, name string, extension string, category string, size long, modified timestamp"
PUSHED = ("folder", "extension", "category")


def category_of(extension: str) -> str:
    """The category of a file by its ending."""
    return next((c for c, endings in K.FILE_CATEGORIES.items() if f".{extension}" in endings), "unknown")


def _store(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return fs.LocalFileSystem(), root


def _found(root: str, folder: str | None, deep: bool) -> Iterator[tuple]:
    """Rows of the files below a folder of the root ('' for the root)."""
    from pyarrow import fs

    store, base = _store(root)
    base = base.rstrip("/")
    for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=deep, allow_not_found=True)):
        parts = f.path[len(base) :].strip("/").split("/")
        if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in parts):
            name = parts[-1]
            extension = name.rpartition(".")[2].lower() if "." in name else ""
            yield f"{base}/{'/'.join(parts)}", folder or "", name, extension, category_of(extension), f.size, f.mtime or datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _folders(root: str) -> list[str]:
    from pyarrow import fs

    store, base = _store(root)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(base.rstrip("/"), allow_not_found=True)) if f.type == fs.FileType.Directory]
    return sorted(n for n in names if not n.startswith((".", "_")))


class Folder(InputPartition):
    def __init__(self, name: str, after: str = "", upto: str = ""):
        self.name, self.after, self.upto = name, after, upto


class ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.asked = root, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                held = self.asked.get(f.attribute[0])
                self.asked[f.attribute[0]] = values if held is None else held & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        chosen = self.asked.get("folder")
        return [Folder(n) for n in ["", *_folders(self.root)] if chosen is None or n in chosen]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for row in _found(self.root, partition.name, bool(partition.name)):
            if all(row[{"folder": 1, "extension": 3, "category": 4}[c]] in v for c, v in self.asked.items()):
                yield row


class ListingStream(DataSourceStreamReader):
    """Offsets are the (time, path) of the last file that was given."""

    def __init__(self, root: str):
        self.root = root

    def _files(self) -> list[tuple[str, tuple]]:
        rows = [r for n in ["", *_folders(self.root)] for r in _found(self.root, n, bool(n))]
        return sorted((json.dumps([r[6].astimezone(datetime.timezone.utc).isoformat(timespec="microseconds"), r[0]]), r) for r in rows)

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Folder(n, start["last"], end["last"]) for n in ["", *_folders(self.root)]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for r in _found(self.root, partition.name, bool(partition.name)):
            at = json.dumps([r[6].astimezone(datetime.timezone.utc).isoformat(timespec="microseconds"), r[0]])
            if partition.after < at <= partition.upto:
                yield r


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veldspar_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileListing)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder."""
    register(spark)
    return spark.read.format("veldspar_files").option("path", path).load()
