"""Scanning a stream of files (an extension): new files are scanned as they come, each content once; and whole bundles
against the stored threat table, which each batch reads and adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palisade.operators import detect, reports
from palisade.operators.threat_store import ThreatStore


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table in a folder as a stream; the table is a folder of files, or one file that is picked by its name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def fresh(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of files with a time `seen`, without contents seen within the delay."""
    return files.withColumn("hash", F.sha2("content", 256)).withWatermark("seen", delay).dropDuplicatesWithinWatermark(["bundle_id", "path", "hash"])


def scan_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the static findings of a stream of files to a Parquet table, as far as the stream has come."""

    def batch(rows: DataFrame, number: int) -> None:
        # A batch that is written again after a failure takes the place of its first try.
        detect.static_findings(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_batch(rows: DataFrame, number: int, root: str, path: str, stream: str, buckets: int) -> None:
    """One batch of files: bundles whose hash the threat table knows are answered from it, the others are scanned, and what
    they show is added to the table.

    Results are written before the table changes, and the table remembers the batch and the version that it read. A batch
    that is run again, whether it died before or after the table's change, reads that version, writes the same results in
    the place of the first ones, and adds nothing."""
    store = ThreatStore(rows.sparkSession, root, buckets)
    last, base = store.version().applied.get(stream, (-1, 0))
    known = store.read(base if last == number else None)
    results, found, new = reports.scan(rows, known, scan_name=f"{stream}-{number}")
    results.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
    found.write.mode("overwrite").parquet(f"{path}/findings/batch={number}")
    store.upsert(new, stream, number)


def scan_bundles(files: DataFrame, store: ThreatStore, path: str, checkpoint: str, stream: str = "scan") -> StreamingQuery:
    """Scan a stream of files (bundle_id, path, text, content), as far as it has come, to the tables results and findings in `path`.

    The files of a bundle that come in one batch are a bundle of that batch. stream: names this stream in the threat table; one name,
    one checkpoint."""

    def batch(rows: DataFrame, number: int) -> None:
        scan_batch(rows, number, store.root, path, stream, store.n)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery) -> None:
    """Wait for a query that ends by itself; raise what it failed with."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
