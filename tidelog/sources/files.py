"""Data sources over folders: the raw archive of compressed bodies, and JSON lines in versions that are swapped in whole.

Folders may be on any file system that Arrow opens by URI and that the driver and all executors reach.

`tidelog_archive` reads and writes bodies at root/yyyy/mm/dd/run/hash.suffix.zst. Days that a filter on `date` rules
out are never listed, and of a listed day each task reads a share of its files.

`tidelog_versions` writes JSON lines into a new version of a folder. Its tasks write files of the version, and the
commit, which is one small file moved over the old one, makes it the current one; so readers see the whole
old version or the whole new one, and a write that fails leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

ARCHIVE = "date date, run string, payload_hash string, suffix string, compressed_size bigint, body binary, intact boolean"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or of a path), and the path there."""
    if "://" not in uri:
        uri = uri.removeprefix("file:") if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def names(files: fs.FileSystem, folder: str, kind: fs.FileType) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind)


def replaced(files: fs.FileSystem, path: str, text: str) -> None:
    """A small file's new content in one step."""
    new = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(new, compression=None) as out:
        out.write(text.encode())
    files.move(new, path)


@dataclass
class Share(InputPartition):
    """Every nth file of a day, from one on."""

    day: str
    first: int
    step: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.shares = options["path"], int(options.get("shares", "4"))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Those on date alone say which days are listed; the rest is Spark's."""
        tests = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v, In: lambda d, v: d in v}
        for one in filters:
            test = tests.get(type(one))
            if test and one.attribute == ("date",) and (isinstance(one.value, date) or type(one) is In):
                self.tests.append((test, one.value))
            else:
                yield one

    def days(self) -> list[str]:
        """Folders yyyy/mm/dd that the filters admit; a year or month is listed only where one of its days may be."""
        files, root = opened(self.root)
        admitted = lambda d: all(test(d, v) for test, v in self.tests)
        single = [v for test, v in self.tests if isinstance(v, date) and test(v, v)]
        if any(test(v, v) and not test(date.min, v) and not test(date.max, v) for test, v in self.tests if isinstance(v, date)):
            # one date is asked for: nothing is listed to find it
            return sorted({f"{d:%Y/%m/%d}" for d in single if admitted(d)})
        out = []
        for year in names(files, root, fs.FileType.Directory):
            for month in names(files, f"{root}/{year}", fs.FileType.Directory):
                out += [f"{year}/{month}/{day}" for day in names(files, f"{root}/{year}/{month}", fs.FileType.Directory) if admitted(date(int(year), int(month), int(day)))]
        return out

    def partitions(self) -> list[Share]:
        return [Share(day, n, self.shares) for day in self.days() for n in range(self.shares)] or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[tuple]:
        files, root = opened(self.root)
        if not partition.day:
            return
        at = date(*map(int, partition.day.split("/")))
        for run in names(files, f"{root}/{partition.day}", fs.FileType.Directory):
            folder = f"{root}/{partition.day}/{run}"
            for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
                # dealt by hash, so that a day of one run has as many shares as one of many
                if not info.base_name.endswith(".zst") or int(hashlib.md5(info.base_name.encode()).hexdigest(), 16) % partition.step != partition.first:
                    continue
                key, _, suffix = info.base_name.removesuffix(".zst").partition(".")
                with files.open_input_stream(info.path, compression="zstd") as stream:
                    body = stream.read()
                yield (at, run, key, f".{suffix}" if suffix else "", info.size, body, hashlib.sha256(body).hexdigest() == key)


class ArchiveWriter(DataSourceWriter):
    """A body goes to a file that is named by its hash, so a task that runs again writes the same files."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = opened(self.root)
        made: set[str] = set()
        for row in iterator:
            body = bytes(row["body"])
            folder = f"{root}/{row['captured_at']:%Y/%m/%d}/{row['run']}"
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            path = f"{folder}/{hashlib.sha256(body).hexdigest()}{row['suffix'] or ''}.zst"
            new = f"{path}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(new, compression=None) as out:
                out.write(pa.compress(body, codec="zstd", asbytes=True))
            files.move(new, path)
        return WriterCommitMessage()


class Archive(DataSource):
    """Reader: ARCHIVE. Writer: captured_at, run, suffix and body."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_archive"

    def schema(self) -> str:
        return ARCHIVE

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class VersionWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.columns, self.version = options["path"], sorted(columns), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = opened(self.root)
        folder = f"{root}/version={self.version}"
        files.create_dir(folder, recursive=True)
        path, n = f"{folder}/{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(path, compression=None) as out:
            for row in iterator:
                out.write((json.dumps({c: row[c] for c in self.columns}, ensure_ascii=False, separators=(",", ":"), default=str) + "\n").encode())
                n += 1
        return Written(path, n)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of the tasks that Spark counts, which leaves out those of attempts that were lost."""
        files, root = opened(self.root)
        done = [m for m in messages if m is not None]
        files.create_dir(root, recursive=True)
        replaced(files, f"{root}/_current", json.dumps({"version": self.version, "files": [m.path for m in done], "rows": sum(m.rows for m in done)}))
        for old in names(files, root, fs.FileType.Directory):
            if old.startswith("version=") and old != f"version={self.version}" and old != self.before:
                files.delete_dir(f"{root}/{old}")

    @property
    def before(self) -> str:
        """The version that was current when the write began stays for readers that have opened it."""
        return f"version={self.was}" if self.was else ""

    was: str | None = None

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.root)
        if files.get_file_info(f"{root}/version={self.version}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/version={self.version}")


def current(path: str) -> dict | None:
    """version, files and rows of a folder's current version; None before the first."""
    files, root = opened(path)
    if files.get_file_info(f"{root}/_current").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{root}/_current") as stream:
        return json.loads(stream.read())


@dataclass
class OneFile(InputPartition):
    path: str


class VersionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[OneFile]:
        return [OneFile(f) for f in (current(self.root) or {"files": []})["files"]] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition.path:
            files, _ = opened(self.root)
            with files.open_input_stream(partition.path) as stream:
                yield from ((line.decode(),) for line in stream.read().splitlines())


class Versions(DataSource):
    """Reader: value, a line. Writer: any columns, mode overwrite."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_versions"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VersionReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        out = VersionWriter(self.options, schema.fieldNames())
        now = current(self.options["path"])
        out.was = now["version"] if now else None
        return out


def register(spark: SparkSession) -> SparkSession:
    for source in (Archive, Versions):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
