"""Addresses to files, within limits, by an opener of the user's; and what was rejected, with the reason.

The opener gives an Answer: its status, the size that it declares, and its content in chunks. Nothing over the limit is kept:
a declared size over it rejects the address before a chunk is read, and reading stops with the chunk that passes it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import stored
from palisade.sources import readers, router

FETCHED = "bundle_id string, address string, path string, content binary, reason string"
BATCH_BYTES = 8 << 20


@dataclass
class Answer:
    status: int = 200
    length: int | None = None  # as declared
    chunks: Iterable[bytes] = field(default_factory=tuple)


Opener = Callable[[str], Answer]


def fetch_one(address: str, opener: Opener, most: int, tries: int, pause: float) -> tuple[bytes | None, str | None]:
    """(content, None) or (None, reason). Errors of the opener, and statuses of 500 and above, are tried again."""
    reason = "no address"
    for attempt in range(tries if address is not None else 0):
        if attempt and pause:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            answer = opener(address)
            if not 200 <= answer.status < 300:
                reason = f"status {answer.status}"
                if answer.status < 500:
                    break
                continue
            if answer.length is not None and answer.length > most:
                return None, f"declares more than {most} bytes"
            parts, size = [], 0
            for chunk in answer.chunks:
                size += len(chunk)
                if size > most:
                    return None, f"holds more than {most} bytes"
                parts.append(chunk)
            return b"".join(parts), None
        except Exception as e:  # noqa: BLE001  whatever the user's opener raises
            reason = f"failed: {type(e).__name__}"
    return None, reason


def fetched(addresses: DataFrame, opener: Opener, most: int = readers.MAX_FILE_BYTES, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """FETCHED of (bundle_id, address): content, or the reason why there is none. A task holds one file and a batch of small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bundle_id", "address", "path", "content", "reason"])

        rows, size = [], 0
        for batch in batches:
            for bundle, address, path in zip(*[c.to_pylist() for c in batch.columns]):
                content, reason = fetch_one(address, opener, most, tries, pause)
                rows.append((bundle, address, path, content, reason))
                size += len(content or b"")
                if size >= BATCH_BYTES or len(rows) >= 1000:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return addresses.select("bundle_id", "address", router.file_name_of(F.col("address")).alias("path")).mapInArrow(run, FETCHED)


def registry_answers(routed: DataFrame, opener: Opener, **limits: float) -> DataFrame:
    """routed sources with the address that the registry's API names, where it names one; else the one to fall back on."""
    asked = routed.where("kind = 'registry'").select(F.col("source").alias("bundle_id"), router.registry_api(F.col("source")).alias("address")).distinct()
    said = fetched(asked, opener, **limits).select(F.col("bundle_id").alias("source"), F.col("content").cast("string").alias("said"))
    address = F.when(F.col("kind") == "registry", router.registry_address(F.col("said"), F.col("address"))).otherwise(F.col("address"))
    return routed.join(said, "source", "left").select("source", "kind", address.alias("address"))


def resolve(sources: DataFrame, opener: Opener, **limits: float) -> tuple[DataFrame, DataFrame]:
    """sources (source, local) that lie elsewhere to (files, rejected (source, kind, reason)).

    files: a row for each source that was fetched, with bundle_id = source. rejected: what was not fetched and why, and sources of which
    the router can make nothing. Sources that lie here are neither; they are read by readers.py."""
    routed = registry_answers(router.routed(sources).distinct(), opener, **limits)
    remote = routed.where("address IS NOT NULL")
    got = fetched(remote.select(F.col("source").alias("bundle_id"), "address"), opener, **limits)
    got = stored(got, "fetched")  # nothing is fetched twice
    failed = got.where("reason IS NOT NULL").select(F.col("bundle_id").alias("source"), "reason").join(routed.select("source", "kind"), "source")
    reason = F.when(F.col("kind") == "unsupported", "this type isn't read").when(F.col("kind") == "missing", "nothing lies there").otherwise("the reference names nothing")
    useless = routed.where("kind IN ('unsupported', 'missing', 'invalid')").select("source", "kind", reason.alias("reason"))
    return readers.with_text(got.where("reason IS NULL")), failed.select("source", "kind", "reason").unionByName(useless)
