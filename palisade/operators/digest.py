"""SHA-256 of many files end to end, as a stream: no bundle is ever one row.

Contents are cut into pieces, dealt by their key and sorted by it and by path components (a secondary sort, which
spills); a task runs the digest over the sorted pieces and holds one Arrow batch of them at a time. SHA-256 takes its
bytes in order, so one key's bytes pass through one task, however many there are; its memory doesn't grow with them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20


def pieces(files: DataFrame, keys: list[str], content: Column, chars: Column | None = None) -> DataFrame:
    """keys, parts (the path's components), piece, data and chars (of the whole file, on its first piece); null content is empty."""
    data = F.coalesce(content, F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length("data") / PIECE_BYTES) - 1, F.lit(0)).cast("int")
    rows = files.select(*keys, F.split("path", "/").alias("parts"), data.alias("data"), (F.lit(0) if chars is None else chars).cast("long").alias("chars"))
    rows = rows.select(*keys, "parts", "data", "chars", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    cut = F.substring(F.col("data"), F.col("piece") * PIECE_BYTES + 1, F.lit(PIECE_BYTES))
    return rows.select(*keys, "parts", "piece", cut.alias("data"), F.when(F.col("piece") == 0, F.col("chars")).otherwise(0).alias("chars"))


def digests(cut: DataFrame, keys: list[str], between: bytes = b"", tasks: int | None = None) -> DataFrame:
    """keys, sha256, n_files and chars of pieces; `between` stands between two files and counts as ASCII characters. tasks: how many
    sort the pieces, by default as many as a shuffle has in this session."""
    names = ["sha256", "n_files", "chars"]
    schema = T.StructType([*[cut.schema[k] for k in keys], T.StructField("sha256", T.StringType()), T.StructField("n_files", T.LongType()), T.StructField("chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, types, digest, files, chars = None, None, hashlib.sha256(), 0, 0

        def made() -> pa.RecordBatch:
            values = [*key, digest.hexdigest(), files, chars]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[*keys, *names])

        for batch in batches:
            types = [*[batch.schema.field(k).type for k in keys], pa.string(), pa.int64(), pa.int64()]
            owners = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            numbers, counts, data = batch.column("piece").to_pylist(), batch.column("chars").to_pylist(), batch.column("data")
            for i, owner in enumerate(owners):
                if owner != key:
                    if key is not None:
                        yield made()
                    key, digest, files, chars = owner, hashlib.sha256(), 0, 0
                elif numbers[i] == 0:
                    digest.update(between)
                    chars += len(between)
                digest.update(data[i].as_buffer())
                files += numbers[i] == 0
                chars += counts[i]
        if key is not None:
            yield made()

    dealt = cut.repartition(*keys) if tasks is None else cut.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*keys, "parts", "piece").mapInArrow(run, schema)
