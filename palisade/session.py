"""Session helpers: the shared folder of the cluster, lineage cuts and Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: What Python is handed at a time where small_batches() holds; Spark's own limits are 64 MB and 10,000 rows.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where none is set (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small table of few row groups would keep a few of them busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within it hand Python about BATCH_BYTES at a time. A worker holds a batch while the next one comes, so that whole
    files in batches of Spark's own size take up to 128 MB in each of an executor's workers."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again: made once though used more often, and safe from lost executors.

    small: it is made under small_batches(), for steps that hand whole files to Python."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession) if small else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str | StructType) -> DataFrame:
    """Apply fn(*columns as Python lists) to each Arrow batch; it returns {column: list} in the output schema."""
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about most_bytes, so that long texts are not all turned into Python objects at once."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
