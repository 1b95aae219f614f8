"""Readers: folders, files, zip and tar archives as rows (bundle_id, path, text, content). Addresses: see fetch.py."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from palisade.functions.text import valid_text
from palisade.sources import folders

MAX_ENTRIES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 10_000, 25 << 20, 100 << 20


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", valid_text(F.col("content"))).select("bundle_id", "path", "text", "content")


def read_folder(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """Files under root; the first `depth` folders below root name the bundle, the rest is the path in it.

    Spark's file index leaves out files and folders whose names start with a dot or an underscore, even if they are
    given. So tasks list and read the folder themselves (see folders.py) where Arrow knows the store; elsewhere what the index
    leaves out is listed through Hadoop's file system by the driver and read by tasks (see `read_hidden`). A file
    that can't be read fails the job."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    address = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri()
    if address.getScheme() in folders.SCHEMES:
        plain = address.getPath() if address.getScheme() == "file" else address.toString()
        rows = folders.read_files(spark, plain, depth=depth)
        content = F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not read: "), "bundle_id", F.lit("/"), "path", F.lit(": "), "error")).cast("binary"))
        return with_text(rows.withColumn("content", content))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return placed(rows, spark, root, depth).unionByName(placed(read_hidden(spark, root), spark, root, depth))


def placed(rows: DataFrame, spark: SparkSession, root: str, depth: int) -> DataFrame:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    at = F.locate(prefix, F.col("path"))
    parts = F.split(F.substring(F.col("path"), at + len(prefix), F.lit(1 << 30)), "/")
    return with_text(rows.select(F.array_join(F.slice(parts, 1, depth), "/").alias("bundle_id"), F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), "/").alias("path"), "content"))


def index_drops(name: str, folder: bool = False) -> bool:
    """Whether Spark's file index leaves out a file or folder of this name."""
    kept = folder and name.startswith(("_common_metadata", "_metadata"))
    return not kept and (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def read_hidden(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files under root that Spark's index leaves out: their own name or that of a folder below
    root is hidden, or they are empty. The driver lists their paths alone. (Hadoop's local file system never lists its checksums, .NAME.crc.)"""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = store.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    listed, found = store.listFiles(at, True), []
    while listed.hasNext():
        status = listed.next()
        path = status.getPath()
        *folders, name = path.toUri().getPath()[len(prefix) :].split("/")
        if status.getLen() == 0 or index_drops(name) or any(index_drops(f, folder=True) for f in folders):
            found.append((path.toString(), path.toUri().getScheme(), path.toUri().getPath(), path.toUri().toString()))
    return read_listed(spark, found)


def read_listed(spark: SparkSession, found: list[tuple[str, str, str, str]]) -> DataFrame:
    """(path, scheme, plain path, address) of files to (path, content); each task opens its files with Arrow's file systems."""
    if not found:
        return spark.createDataFrame([], "path string, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, scheme, plain, address in zip(*[c.to_pylist() for c in batch.columns]):
                store, name = (fs.LocalFileSystem(), plain) if scheme == "file" else fs.FileSystem.from_uri(address)
                with store.open_input_stream(name, compression=None) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stream.read()], pa.binary())], names=["path", "content"])

    rows = spark.createDataFrame(found, "path string, scheme string, plain string, address string")
    return rows.repartition(min(len(found), 200)).mapInArrow(run, "path string, content binary")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if index_drops(at.getName()):
        at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
        rows = read_listed(spark, [(at.toString(), at.toUri().getScheme(), at.toUri().getPath(), at.toUri().toString())])
    else:
        rows = spark.read.format("binaryFile").load(path)
    return with_text(rows.select(F.col("path").alias("bundle_id"), F.element_at(F.split("path", "/"), -1).alias("path"), "content"))


def safe_name(name: str) -> str | None:
    """An entry's name without anything that leaves the bundle; None if nothing is left."""
    parts = [p for p in name.replace("\\", "/").replace("\0", "").split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or None


def read_most(stream: io.BufferedIOBase, most: int) -> int:
    """How many bytes a stream holds, counted up to one more than `most`; none are kept."""
    total = 0
    while total <= most and (piece := stream.read(min(1 << 16, most + 1 - total))):
        total += len(piece)
    return total


def unzip(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files of a zip archive, one by one. An archive that breaks the limits raises before any comes: sizes
    are counted while unpacking, since a header can lie."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"the archive has more than {MAX_ENTRIES} entries")
        entries, total = [e for e in entries if not e.is_dir()], 0
        for entry in entries:
            with archive.open(entry) as f:
                total += (size := read_most(f, MAX_FILE_BYTES))
            check_size(size, total)

    def files() -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for entry in entries:
                if (name := safe_name(entry.filename)) is not None:
                    yield name, archive.read(entry)

    return files()


class WholeHeader(tarfile.TarInfo):
    """tarfile takes a header that is cut or broken for the end of the archive; here it is an error."""

    @classmethod
    def frombuf(cls, buf: bytes, encoding: str, errors: str) -> tarfile.TarInfo:
        try:
            return super().frombuf(buf, encoding, errors)
        except (tarfile.TruncatedHeaderError, tarfile.InvalidHeaderError) as e:
            raise tarfile.ReadError(f"the archive is cut or broken: {e}") from None


def untar(content: bytes) -> Iterator[tuple[str, bytes]]:
    """The same for tar.gz; links and other special entries are left out. The first pass reads the gzip stream to its end, whose
    checksum and length say that nothing is missing, wherever an archive is cut."""
    total = 0
    with gzip.open(io.BytesIO(content)) as stream:
        with tarfile.open(fileobj=stream, mode="r|", tarinfo=WholeHeader) as archive:
            for i, entry in enumerate(archive):
                if i >= MAX_ENTRIES:
                    raise ValueError(f"the archive has more than {MAX_ENTRIES} entries")
                total += entry.size
                check_size(entry.size, total)
        check_size(0, read_most(stream, MAX_TOTAL_BYTES))

    def files() -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as archive:
            for entry in archive:
                if entry.isfile() and (name := safe_name(entry.name)) is not None:
                    yield name, archive.extractfile(entry).read()

    return files()


def check_size(one: int, total: int) -> None:
    if one > MAX_FILE_BYTES:
        raise ValueError(f"a file has more than {MAX_FILE_BYTES} bytes")
    if total > MAX_TOTAL_BYTES:
        raise ValueError(f"the archive has more than {MAX_TOTAL_BYTES} bytes")


class Unpack:
    """A table function: (path, content, reason) of an archive's files, or one row with the reason why it has none.

    Spark takes the rows as they come; what a task holds is one archive, one of its files, and what waits to be sent."""

    def eval(self, kind: str | None, content: bytes | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        try:
            found = {"zip": unzip, "tar": untar}[kind](bytes(content or b""))
        except KeyError:
            yield None, None, f"no archive that can be read: {kind}"
            return
        except (ValueError, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error, zipfile.BadZipFile, tarfile.TarError) as e:
            yield None, None, str(e)[:200] or type(e).__name__
            return
        for path, data in found:
            yield path, data, None


def register_unpack(spark: SparkSession) -> None:
    """Make the table function unpack(kind, content) known to SQL."""
    spark.udtf.register("unpack", udtf(Unpack, returnType="path string, content binary, reason string"))


def entries(archives: DataFrame) -> DataFrame:
    """(bundle_id, path, content, reason) of archives (bundle_id, kind 'zip' or 'tar', content), by a lateral join."""
    table = udtf(Unpack, returnType="path string, content binary, reason string")
    asked = archives.select("bundle_id", F.col("kind").alias("k"), F.col("content").alias("c"))
    return asked.lateralJoin(table(F.col("k").outer(), F.col("c").outer())).select("bundle_id", "path", "content", "reason")


def unpack(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """archives (bundle_id, kind 'zip' or 'tar', content) to (files, rejected (bundle_id, reason)). An archive is either read
    whole or rejected."""
    rows = entries(archives)
    return with_text(rows.where(F.col("reason").isNull())), rows.where(F.col("reason").isNotNull()).select("bundle_id", "reason")
