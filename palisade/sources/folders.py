"""Folders of files as a Spark data source, batch and stream: format "bundle_files".

    spark.read.format("bundle_files").load(root)             every file below root, hidden or not
    spark.readStream.format("bundle_files").load(root)       the files that come, by their time of change

Columns: bundle_id, path, size, changed (time of the last change), content, error (why content is null; else null).

The driver lists nothing. Bundles (the folders `depth` levels below root, after `skip` levels that name no bundle) are dealt to
`groups` by a hash of their names, and the files of each bundle to `splits` by a hash of their paths, so that one
large bundle is read by `splits` tasks; each task lists its own group. A batch of files read is bounded by
BATCH_BYTES and one file. Files are opened with Arrow's file systems: local paths, hdfs, s3, gs and abfs.

The options bundles (a JSON list of names), bundle_start and path_start decide which folders are listed and which files are opened; see
read_files(). They are options, not filters that Spark pushes down: in Spark 4.1 a Python source keeps a pushed filter
with the loaded table, so that a later use of the same DataFrame without the filter would miss rows (tests show it)."""

from __future__ import annotations

import json
import posixpath
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "bundle_id string, path string, size long, changed timestamp, content binary, error string"
ARROW = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("changed", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string())])
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000
#: Stores whose files Arrow opens in tasks.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it of a plain path or an address."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(root)
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def part_of(name: str, parts: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % parts


def entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds, without the checksums that Hadoop's local file system puts beside its files (.NAME.crc)."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = {x.base_name for x in found}
    return sorted((x for x in found if not (x.base_name.startswith(".") and x.base_name.endswith(".crc") and x.base_name[1:-4] in names)), key=lambda x: x.base_name)


@dataclass
class Slice(InputPartition):
    group: int
    split: int
    after: float = -1.0  # seconds; files changed later than this and not later than `until`
    until: float = float("inf")


@dataclass
class Walk:
    """What the tasks do, by the options."""

    root: str
    depth: int
    skip: int
    groups: int
    splits: int
    bundles: frozenset[str] | None  # all, if None
    bundle_start: str
    path_start: str

    def slices(self) -> list[Slice]:
        return [Slice(g, s) for g in range(self.groups) for s in range(self.splits)]

    def wanted_bundle(self, bundle: str) -> bool:
        return (self.bundles is None or bundle in self.bundles) and bundle.startswith(self.bundle_start)

    def wanted_below(self, folder: str) -> bool:
        """Whether a folder of a bundle can hold a wanted path."""
        start = folder + "/"
        return self.path_start.startswith(start) or start.startswith(self.path_start)

    def files(self, store: fs.FileSystem, root: str, at: Slice) -> Iterator[tuple[str, str, fs.FileInfo]]:
        """(bundle_id, path, file) of a slice. Files above the bundles' level have the bundle ''."""

        def below(folder: str, bundle: str, path: str) -> Iterator[tuple[str, str, fs.FileInfo]]:
            for entry in entries(store, folder):
                inner = f"{path}/{entry.base_name}" if path else entry.base_name
                if entry.type == fs.FileType.Directory:
                    if self.wanted_below(inner):
                        yield from below(entry.path, bundle, inner)
                elif part_of(inner, self.splits) == at.split and inner.startswith(self.path_start):
                    yield bundle, inner, entry

        def above(folder: str, parts: tuple[str, ...]) -> Iterator[tuple[str, str, fs.FileInfo]]:
            for entry in entries(store, folder):
                inner = (*parts, entry.base_name)
                if entry.type == fs.FileType.Directory:
                    if len(inner) < self.skip + self.depth:
                        yield from above(entry.path, inner)
                        continue
                    bundle = "/".join(inner[self.skip :])
                    if part_of("/".join(inner), self.groups) == at.group and self.wanted_bundle(bundle):
                        yield from below(entry.path, bundle, "")
                elif (path := "/".join(inner)) and part_of(path, self.groups * self.splits) == at.group * self.splits + at.split:
                    if self.wanted_bundle("") and path.startswith(self.path_start):
                        yield "", path, entry

        yield from above(root, ())

    def read(self, at: Slice) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        rows, size = [], 0
        for bundle, path, entry in self.files(store, root, at):
            changed = entry.mtime or datetime.fromtimestamp(0, UTC)
            if not at.after < changed.timestamp() <= at.until:
                continue
            content, error = None, None
            try:
                with store.open_input_stream(entry.path, compression=None) as stream:
                    content = stream.read()
            except OSError as e:  # it went after it was listed, or can't be read
                error = str(e)[:200]
            rows.append((bundle, path, entry.size if content is None else len(content), changed, content, error))
            size += len(content or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def walk_of(options: dict[str, str]) -> Walk:
    number = lambda name, least, default: max(least, int(options.get(name, default)))
    bundles = frozenset(json.loads(options["bundles"])) if "bundles" in options else None
    sizes = number("depth", 1, 1), number("skip", 0, 0), number("groups", 1, 32), number("splits", 1, 2)
    return Walk(options["path"], *sizes, bundles, options.get("bundle_start", ""), options.get("path_start", ""))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = walk_of(options)

    def partitions(self) -> list[Slice]:
        return self.walk.slices()

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.walk.read(partition)


class FolderStreamReader(DataSourceStreamReader):
    """An offset is a time; a batch holds the files changed after its start and not after its end. A file that is changed comes again. `settle` seconds
    are left for files that are still being written; a file that comes with an older time of change than that isn't seen."""

    def __init__(self, options: dict[str, str]):
        self.walk, self.settle = walk_of(options), float(options.get("settle", "2"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1.0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": round(time.time() - self.settle, 3)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(s.group, s.split, start["until"], end["until"]) for s in self.walk.slices()]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.walk.read(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema: StructType) -> FolderStreamReader:  # noqa: N802
        return FolderStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FolderSource)


def read_files(
    spark: SparkSession, root: str, *, depth: int = 1, skip: int = 0, bundles: list[str] | None = None, bundle_start: str = "", path_start: str = "",
    groups: int = 32, splits: int = 2, stream: bool = False,
) -> DataFrame:
    """The files below root, or those of some bundles and with some beginning of their paths; as a stream if asked."""
    register(spark)
    options = {"depth": depth, "skip": skip, "bundle_start": bundle_start, "path_start": path_start, "groups": groups, "splits": splits}
    options |= {} if bundles is None else {"bundles": json.dumps(bundles)}
    return (spark.readStream if stream else spark.read).format("bundle_files").options(**options).load(root)
