"""Rows as files of their own: format "named_files", for reports and for folders of bundles.

    rows.write.format("named_files").mode("append").save(root)      rows (name string, content binary)

Tasks write below a hidden folder of the job; the commit gives each task's finished folder its name and then the whole
job its place, root/job-ID/part-NNNNN/NAME, by one rename. Until then no reader sees a file of it; a task that fails takes its own folder away,
and an aborted job its whole folder. The driver holds one line for each task. With mode "overwrite" the jobs that stood in root go after
the rename. Parts of a name that would lead out of the folder are dropped; two rows of a task with one name fail the job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from palisade.session import small_batches
from palisade.sources.folders import opened
from palisade.sources.readers import safe_name


@dataclass
class Written(WriterCommitMessage):
    part: int
    folder: str
    files: int


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.root)
        return store, root, f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, _, staging = self._staging()
        name = f"attempt-{context.partitionId()}-{context.taskAttemptId()}"
        folder, seen = f"{staging}/{name}", set()
        store.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for row, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    at = safe_name(row or "")
                    if at is None or at in seen:
                        raise ValueError(f"a file needs a name of its own: {row!r}")
                    seen.add(at)
                    if "/" in at:
                        store.create_dir(f"{folder}/{at.rpartition('/')[0]}", recursive=True)
                    with store.open_output_stream(f"{folder}/{at}", compression=None) as out:
                        if content.is_valid:
                            out.write(content.as_buffer())
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(context.partitionId(), name, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staging = self._staging()
        store.create_dir(staging, recursive=True)  # a job without rows has none
        kept = {m.folder: m for m in messages if m is not None}
        for entry in store.get_file_info(fs.FileSelector(staging)):
            written = kept.get(entry.base_name)
            if written is None or not written.files:
                store.delete_dir(entry.path)  # of an attempt that another one stands for
            else:
                store.move(entry.path, f"{staging}/part-{written.part:05d}")
        before = [x for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("job-")]
        store.move(staging, f"{root}/job-{self.job}")
        for entry in before if self.overwrite else []:
            store.delete_dir(entry.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write_files(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Write rows (name, content) below root, as described above."""
    register(rows.sparkSession)
    with small_batches(rows.sparkSession):
        rows.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode(mode).save(root)


def write_folder(files: DataFrame, root: str, tasks: int = 32, mode: str = "append") -> None:
    """Write files (bundle_id, path, content) as root/job-ID/part-NNNNN/BUNDLE/PATH; folders.py reads them again with
    skip=2 where a bundle's name is one folder."""
    placed = files.select(F.concat_ws("/", "bundle_id", "path").alias("name"), "content")
    write_files(placed.repartition(tasks, "name"), root, mode)
