"""The threat table on storage: versions that share what didn't change.

Rows lie in buckets of their hash. A version is a small file that names the folder of each bucket; an upsert reads and writes the
buckets alone that its new rows touch, and the next version takes all other folders over (copy on write). A version becomes
visible by one rename that fails if its number is taken. Readers take the highest number, so they see a whole
version or the one before; a writer that dies leaves folders that no version names. A writer that finds its number taken
starts again from the version that took it, so no upsert is lost.

A version also keeps, for each stream that writes to the table, the last batch applied and the version that batch
started from: a batch that is run again changes nothing and can read what it read the first time.

The driver holds the names of the buckets' folders, not rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.threats import COLUMNS

BUCKETS, TRIES = 64, 20


@dataclass
class Version:
    number: int = 0
    buckets: dict[int, str] = field(default_factory=dict)
    applied: dict[str, list[int]] = field(default_factory=dict)  # stream to [last batch, version it started from]


class Conflict(Exception):
    """Another writer took the version's number."""


class ThreatStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """root: a folder that all executors see. buckets: fixed when the table is made; it must be the same for all writers."""
        self.spark, self.root, self.n = spark, root.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._versions = self._hadoop.Path(f"{self.root}/versions")
        self._store = self._versions.getFileSystem(self._conf)

    # ---- versions ----

    def numbers(self) -> list[int]:
        if not self._store.exists(self._versions):
            return []
        names = [s.getPath().getName() for s in self._store.listStatus(self._versions)]
        return sorted(int(x[: -len(".json")]) for x in names if x.endswith(".json") and x[: -len(".json")].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last one; version 0 is empty."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version()
        stream = self._store.open(self._hadoop.Path(f"{self.root}/versions/{number:08d}.json"))
        try:
            data = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(number, {int(k): v for k, v in data["buckets"].items()}, data["applied"])

    def _publish(self, version: Version) -> None:
        """Write aside, then rename: the rename fails if the number is taken."""
        self._store.mkdirs(self._versions)
        aside = self._hadoop.Path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self._store.create(aside, False)
        stream.write(bytearray(json.dumps({"buckets": version.buckets, "applied": version.applied}).encode()))
        stream.close()
        target = self._hadoop.Path(f"{self.root}/versions/{version.number:08d}.json")
        none = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._versions.toUri(), self._conf).rename(aside, target, none)
        except Py4JJavaError as e:
            self._store.delete(aside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version.number} is taken") from None
            raise

    # ---- rows ----

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("hash"), F.lit(self.n)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(*[f"{self.root}/data/{x}" for x in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version (hash, category, severity, description, added_at), one for each hash."""
        return self._rows(sorted(self.version(number).buckets.values()))

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> Version:
        """Put new rows (hash, category, severity, description), one for each hash, in the place of those with their hash.

        With a stream and a batch number the batch is applied once: a number not above the last one changes nothing."""
        made = None
        for _ in range(TRIES):
            base = self.version()
            if stream is not None and batch is not None and base.applied.get(stream, [-1])[0] >= batch:
                return base
            if made is None or made[0] != base.number:
                made = base.number, self._next(base, new)
            version = made[1]
            if stream is not None and batch is not None:
                version.applied = {**base.applied, stream: [batch, base.number]}
            if version.buckets == base.buckets and version.applied == base.applied:
                return base  # nothing new
            try:
                self._publish(version)
                return version
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were faster")

    def _next(self, base: Version, new: DataFrame) -> Version:
        """Write the touched buckets' next state; the version that names it isn't visible yet."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/{folder}"
        fresh = new.select("hash", "category", "severity", "description").where(F.col("hash").isNotNull()).withColumn("added_at", F.current_timestamp()).withColumn("bucket", self._bucket())
        fresh.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/new")
        fresh = self.spark.read.schema(f"{COLUMNS}, bucket int").parquet(f"{path}/new")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # numbers below self.n
        if not touched:
            return Version(base.number + 1, dict(base.buckets), base.applied)
        there = [b for b in touched if b in base.buckets]
        if there:
            old = self._rows([base.buckets[b] for b in there]).withColumn("bucket", self._bucket())
            kept = old.join(fresh.select("hash"), "hash", "left_anti").select(*fresh.columns)
            kept.unionByName(fresh).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/all")
        part = f"{folder}/{'all' if there else 'new'}"
        return Version(base.number + 1, base.buckets | {b: f"{part}/bucket={b}" for b in touched}, base.applied)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete versions but the last `keep`, and then folders that none of the rest names; a writer at work must not be disturbed,
        so call it when there is none. Returns the names of the folders that went."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self._store.delete(self._hadoop.Path(f"{self.root}/versions/{number:08d}.json"), False)
        used = {x.split("/")[0] for number in numbers[-keep:] for x in self.version(number).buckets.values()}
        data, gone = self._hadoop.Path(f"{self.root}/data"), []
        for status in self._store.listStatus(data) if self._store.exists(data) else []:
            if (name := status.getPath().getName()) not in used:
                self._store.delete(status.getPath(), True)
                gone.append(name)
        return gone
