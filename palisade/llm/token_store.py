"""Token-ID output: documents as token ids, each compressed alone with one shared zstandard dictionary.

A store is a folder written by Spark's Parquet writer, so it can lie in any store that Spark reaches and a lost
executor's part is written again:
  shards/      rows in ascending document order, each with a binary `blob` (MAGIC, dictionary hash, then a zstandard
               frame for each document) and its index: doc_ids, offsets of the frames in the blob, n_tokens
  dictionary/  one row: dict_hash (SHA-256 of the dictionary), dictionary, id_bytes, tokenizer, end_id
Ids are little-endian unsigned, of 2 bytes where the vocabulary allows, else 4. `read_document` needs the index of
one shard and one frame.

The dictionary is trained on the ids of about DICT_DOCS documents, sampled over all files, cut to DICT_TOKENS ids each (it changes sizes,
never contents); too few ids for training give an empty dictionary.

Defined results: a null or empty text is the end id alone; repeated rows are written each; rows with a null doc_id
come first; ties in doc_id are ordered by their frames; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.session import map_batches, shared_path, slices

MAGIC = b"PLTOK001"
DICT_DOCS, DICT_TOKENS, DICT_BYTES = 1000, 1024, 64 << 10
#: Bytes of a shard's frames and rows of a range of documents that one task orders.
SHARD_BYTES, ROWS_PER_TASK = 1 << 20, 16_000
LEVEL, CACHED_PARTS = 3, 600_000


# The split pattern that the fast path knows, the same for lower-case texts of code points below 256,
# and the characters that Python takes for white space but the tokenizer doesn't.
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN_PARTS = re.compile("[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[^ \t\n\x0b\x0c\r\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
ASCII_PARTS = re.compile("[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
ONLY_PYTHON_SPACE = b"\x1c\x1d\x1e\x1f"


class Encoder:
    """The tokenizer, with a cache of the ids of the parts that its split pattern makes.

    Parts are encoded one by one, so a text's ids are those of its parts end to end. Texts of code points below 256
    are split here (there, lower case and NFC are plain), others at white space only; texts that may hold a special
    token, and all texts of a tokenizer with other rules, are encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        first = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.splits = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT_PATTERN}
        self.known: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def parts(self, text: str) -> list[str]:
        if not self.splits or "<|" in text:
            return [text] if text else []
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return [text] if any(chr(c) in text for c in ONLY_PYTHON_SPACE) else text.split()
        if len(raw.translate(None, ONLY_PYTHON_SPACE)) < len(raw):
            return [text]
        return (ASCII_PARTS if text.isascii() else LATIN_PARTS).findall(text.lower())

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts not seen before. Parts without white space are encoded as one text: each part of the text is
        one of the tokenizer's words, and the words are told apart by their numbers."""
        code, out = "H" if self.dtype.itemsize == 2 else "I", {}
        for at in range(0, len(parts), 2048):
            some = parts[at : at + 2048]
            joined = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, words = joined.ids, joined.word_ids
            if len(words) and words[-1] == len(some) - 1 and len(set(words)) == len(some):
                cuts = np.searchsorted(words, np.arange(len(some) + 1)).tolist()
                whole = array(code, ids)
                out.update((p, whole[a:b].tobytes()) for p, a, b in zip(some, cuts, cuts[1:]))
            else:  # a part that is more than one word, or none
                out.update((p, array(code, e.ids).tobytes()) for p, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, without special tokens."""
        parts, known = self.parts(text or ""), self.known
        got = list(map(known.get, parts))
        if None in got:
            new = self.encode_new(list({p for p, ids in zip(parts, got) if ids is None}))
            if len(known) < CACHED_PARTS and self.splits:  # the first parts seen are the frequent ones; a full cache stays as it is
                known.update(new)
            got = [new[p] if ids is None else ids for p, ids in zip(parts, got)]
        return np.frombuffer(b"".join(got), self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(texts: list[str], tokenizer_path: str) -> bytes:
    samples = [encoder(tokenizer_path).encode(t)[:DICT_TOKENS].tobytes() for t in texts]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in samples if s], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(docs: DataFrame, tokenizer_path: str, end_id: int, dictionary: bytes) -> DataFrame:
    """(doc_id, n_tokens, frame): the compressed ids of each document, end id included."""

    def run(ids: list, texts: list) -> dict:
        enc = encoder(tokenizer_path)
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        end = np.array([end_id], enc.dtype)
        got = [np.concatenate([enc.encode(t), end]) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(x) for x in got], "frame": [packer.compress(x.tobytes()) for x in got]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, frame binary")


def shards(ordered: DataFrame, dict_hash: str) -> DataFrame:
    """Pack each partition's documents, in order, into shards of about SHARD_BYTES."""
    schema = "part long, shard long, n_docs long, n_tokens long, first_doc_id long, last_doc_id long, doc_ids array<long>, offsets array<long>, doc_tokens array<long>, blob binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        head = MAGIC + bytes.fromhex(dict_hash)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, tokens = [x[0] for x in held], [x[1] for x in held]
            offsets = (len(head) + np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])).tolist()
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist(
                [{"part": part, "shard": shard, "n_docs": len(ids), "n_tokens": sum(tokens), "first_doc_id": min(known, default=None), "last_doc_id": max(known, default=None), "doc_ids": ids, "offsets": offsets, "doc_tokens": tokens, "blob": head + b"".join(x[2] for x in held)}],
                schema=pa.schema([*[(n, pa.int64()) for n in ("part", "shard", "n_docs", "n_tokens", "first_doc_id", "last_doc_id")], *[(n, pa.list_(pa.int64())) for n in ("doc_ids", "offsets", "doc_tokens")], ("blob", pa.binary())]),
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    return ordered.mapInArrow(pack, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Write docs (doc_id, text) as a token store at path."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    # About DICT_DOCS documents from all files, not the first ones; a sequence of ids decodes alike with any dictionary.
    share = DICT_DOCS / max(DICT_DOCS, docs.count())
    sample = [r[0] for r in docs.where("text IS NOT NULL").select(F.substring("text", 1, 8 * DICT_TOKENS)).sample(share, seed=0).collect()]
    dictionary = train_dictionary(sample, tokenizer_path)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    # The frames are kept as a table of their own: ranges are then found without encoding again.
    packed = f"{path}/frames"
    frames(docs, tokenizer_path, end_id, dictionary).write.parquet(packed, compression="uncompressed")
    rows = spark.read.parquet(packed)
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    ordered = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "frame")
    shards(ordered, dict_hash).write.parquet(f"{path}/shards", compression="uncompressed")
    row = [(dict_hash, bytearray(dictionary), encoder(tokenizer_path).dtype.itemsize, tokenizer_path, end_id)]
    spark.createDataFrame(row, "dict_hash string, dictionary binary, id_bytes int, tokenizer string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    _delete(spark, packed)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, np.dtype]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary), np.dtype(f"<u{row.id_bytes}")


def unpacker(blob: bytes, dict_hash: str, dictionary: bytes) -> zstandard.ZstdDecompressor:
    if blob[: len(MAGIC)] != MAGIC or blob[len(MAGIC) : len(MAGIC) + 32].hex() != dict_hash:
        raise ValueError("the shard was not written with this dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, shard, at, doc_id, n_tokens, ids_crc32, before, ids) for each document: `at` is its place in the shard,
    `before` the number of ids before it in the shard, ids_crc32 that of its ids as unsigned 32-bit integers. ids are
    most of the bytes, so they only leave a task if they are asked for."""
    dict_hash, dictionary, dtype = open_dictionary(spark, path)
    names = ("part", "shard", "at", "doc_id", "n_tokens", "ids_crc32", "before")
    arrow = pa.schema([*[(n, pa.int64()) for n in names], *[("ids", pa.binary())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            for part, shard, ids, offsets, blob in zip(*[c.to_pylist() for c in batch.columns]):
                unpack, before, rows = unpacker(blob, dict_hash, dictionary), 0, []
                for at, doc_id in enumerate(ids):
                    got = np.frombuffer(unpack.decompress(blob[offsets[at] : offsets[at + 1]]), dtype).astype("<u4")
                    rows.append((part, shard, at, doc_id, len(got), zlib.crc32(got), before, *([got.tobytes()] if with_ids else [])))
                    before += len(got)
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    return spark.read.parquet(f"{path}/shards").select("part", "shard", "doc_ids", "offsets", "blob").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with this doc_id): only the shards whose range holds it, and only its frames."""
    dict_hash, dictionary, dtype = open_dictionary(spark, path)
    found = spark.read.parquet(f"{path}/shards").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).where(F.array_contains("doc_ids", doc_id))
    out = []
    for row in found.orderBy("part", "shard").toLocalIterator():
        unpack = unpacker(bytes(row.blob), dict_hash, dictionary)
        out += [np.frombuffer(unpack.decompress(bytes(row.blob[row.offsets[i] : row.offsets[i + 1]])), dtype).tolist() for i, x in enumerate(row.doc_ids) if x == doc_id]
    return out


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs to a store in the shared folder and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    index = spark.read.parquet(f"{path}/shards").select("part", "shard", "n_tokens")
    # Starts of the parts (few: ROWS_PER_TASK documents each), then of the shards within each part.
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("part_start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = index.withColumn("shard_start", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    starts = within.join(parts, "part").select("part", "shard", (F.coalesce("part_start", F.lit(0)) + F.coalesce("shard_start", F.lit(0))).alias("base"))
    rows = read_tokens(spark, path, with_ids=False).select("part", "shard", "doc_id", "n_tokens", "ids_crc32", "before")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
