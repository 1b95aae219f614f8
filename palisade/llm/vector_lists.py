"""Integer vectors in lists of near rows: k-means centroids, lists dealt over shards, and searches in two passes.

Rows are assigned to their nearest centroid, ranged over shards by (cluster, id) and packed into lists: one row of
the stored index holds a list's ids and the matrix of its vectors, with what bounds its scores. A cluster of any size
is cut into lists of bounded length and over as many shards as it fills. Each shard also has one row that bounds all
its lists, so that the pairs of queries and shards that can matter are known before any vector moves.

A search first visits, for each query, the shard with the highest bound. The kth score found there is the floor of the
second pass, in which a query goes to those other shards alone whose bound reaches it. A task holds one shard and a
bounded part of its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import slices, stored

#: k-means is fitted on a sample of about so many rows (and numbers) of the whole table; every row is assigned.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_CENTROIDS, ROUNDS, SEED = 8192, 1 << 22, 1024, 8, 17
#: Numbers of a shard, queries that meet a shard in one task, and bytes of shard bounds that are broadcast at a time.
SHARD_NUMBERS, QUERIES_PER_TASK, BOUND_BYTES = 1 << 22, 1 << 14, 32 << 20
MOST_TASKS = 8192  # partitions that the pairs of shards and queries are dealt over; a task takes one pair at a time
EXACT = 1 << 53  # sums of integer products below this are exact as doubles
LONGS = (-(1 << 63), (1 << 63) - 1)
LIST = "shard int, list int, ids array<long>, labels array<long>, kind string, vectors binary, bound binary"
FOUND = "key long, slot int, vec_id long, score long"


def whole_vectors(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; what lies beyond the longs becomes the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix; what a shorter vector lacks is zero."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with a query, as longs; sums beyond the longs become the nearest long."""
    if rows.dtype == np.float64:
        return (rows @ query).astype(np.int64)
    return np.clip(rows @ query.astype(object), *LONGS).astype(np.int64)


def exact_rows(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows as doubles where sums of their products with numbers up to `most` are exact, else as Python integers."""
    high = float(np.abs(rows.astype(np.float64)).max(initial=0))
    return rows.astype(np.float64) if high * max(most, 1) * max(rows.shape[1], 1) < EXACT else rows.astype(object)


@dataclass
class Index:
    lists: DataFrame
    bounds: DataFrame  # the rows of LIST that bound a shard
    centers: np.ndarray
    width: int
    shards: int  # one more than the highest number


def sums(rows: DataFrame) -> tuple[int, int]:
    got = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    return got[0], max(got[1] or 0, 1)


def centroids(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """About sqrt(n) k-means centroids of a seeded sample of rows (vec_id, q)."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(max(1, n // most))) == 0).select("q").limit(2 * most).toArrow()
    x = matrix(sample.column("q").combine_chunks(), width).astype(np.float64)
    k = min(MOST_CENTROIDS, max(1, round(n**0.5)), max(1, len(x) // 4))
    if not len(x):
        return np.zeros((1, width))
    rng = np.random.default_rng(SEED)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centers)
        counts = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * (x @ centers.T), axis=1)


def build(rows: DataFrame, list_rows: int, bound: Callable[[np.ndarray, int, np.ndarray], bytes], merge: Callable[[list[tuple[int, bytes]]], bytes]) -> Index:
    """The stored index of rows (vec_id, label, q). bound(vectors, cluster, centers) describes a list, merge() a shard."""
    rows = stored(rows.select("vec_id", "label", "q"), "vectors")
    n, width = sums(rows)
    centers = centroids(rows, n, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cluster = nearest(matrix(part.column("q"), width).astype(np.float64), centers)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cluster, pa.int32())], names=["vec_id", "label", "q", "cluster"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by cluster; lists end where a cluster ends or list_rows are reached."""
        shard, made, described = TaskContext.get().partitionId(), 0, []

        def row(number: int, ids: list, labels: list, kind: str, vectors: bytes, about: bytes) -> pa.RecordBatch:
            values = [shard, number, ids, labels, kind, vectors, about]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in LIST.split(", ")])

        def listed(table: pa.Table) -> pa.RecordBatch:
            vectors, cluster = matrix(table.column("q").combine_chunks(), width), table.column("cluster")[0].as_py()
            kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or -(1 << (8 * int(k[2]) - 1)) <= vectors.min(initial=0) and vectors.max(initial=0) < 1 << (8 * int(k[2]) - 1))
            described.append((cluster, about := bound(vectors, cluster, centers)))
            return row(made, table.column("vec_id").to_pylist(), table.column("label").to_pylist(), kind, vectors.astype(kind).tobytes(), about)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and len(held) else table
            while len(held):
                cluster = held.column("cluster").to_numpy()
                end = min(list_rows, int(np.argmax(cluster != cluster[0])) if cluster[-1] != cluster[0] else len(cluster))
                if end == len(held) and end < list_rows:
                    break  # the list may go on in the next batch
                yield listed(held.slice(0, end))
                made, held = made + 1, held.slice(end)
        if held is not None and len(held):
            yield listed(held)
        if described:
            yield row(-1, [], [], "", b"", merge(described))

    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(2 * cores, -(-n * width // SHARD_NUMBERS))
    assigned = rows.mapInArrow(assign, "vec_id long, label long, q array<long>, cluster int")
    order = ["cluster", "vec_id", "label"]
    lists = stored(assigned.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(pack, LIST), "lists")
    return Index(lists.where("list >= 0"), lists.where("list < 0"), centers, width, (lists.agg(F.max("shard")).first()[0] or 0) + 1)


def vectors_of(lists: pa.Table, width: int) -> list[np.ndarray]:
    return [np.frombuffer(v, k).reshape(-1, width).astype(np.int64) for k, v in zip(lists.column("kind").to_pylist(), lists.column("vectors").to_pylist())]


#: reach(query columns, bounds of shards) -> (upper bounds, pairs that can matter), both queries x shards.
Reach = Callable[[dict[str, pa.Array], list[bytes]], tuple[np.ndarray, np.ndarray]]
Visit = Callable[[pa.Table, pa.Table], dict[str, list]]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (key, slot) by score, then by vec_id; rank counts from 1."""
    order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, reach: Reach, visit: Visit, k: int) -> DataFrame:
    """FOUND and rank: the first k rows of each slot of each query.

    queries: (key, q, ...), a stored table; visit() gets queries with the column floor, a map from slot to a
    score that k rows reach, and the lists of one shard."""
    spark = queries.sparkSession
    shards = index.bounds.select("shard", "bound")
    step = max(1, BOUND_BYTES // max(1, shards.agg(F.max(F.length("bound"))).first()[0] or 1))
    chunks = [(low, min(low + step, index.shards)) for low in range(0, index.shards, step)]

    def known(low: int, high: int) -> tuple[list[int], list[bytes]]:
        got = shards.where(F.col("shard").between(low, high - 1)).orderBy("shard").collect()
        return [r.shard for r in got], [bytes(r.bound) for r in got]

    def routed(rows: DataFrame, low: int, high: int) -> DataFrame:
        """Adds the shard of the highest bound to the array home."""
        numbers, bounds = known(low, high)
        there = spark.sparkContext.broadcast((np.array(numbers, np.int32), bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, bounds = there.value
                for part in slices(batch):
                    columns = dict(zip(part.schema.names, part.columns))
                    best = numbers[np.argmax(reach(columns, bounds)[0], axis=1)].tolist() if bounds else [None] * len(part)
                    home = [h + [b] for h, b in zip(columns["home"].to_pylist(), best)]
                    yield part.set_column(part.schema.get_field_index("home"), "home", pa.array(home, pa.list_(pa.int32())))

        return rows.mapInArrow(run, rows.schema)

    def further(rows: DataFrame, low: int, high: int) -> DataFrame:
        """A row for each query and each shard, but its home, whose bound reaches the floor."""
        numbers, bounds = known(low, high)
        there = spark.sparkContext.broadcast((np.array(numbers, np.int32), bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, bounds = there.value
                for part in slices(batch, 1 << 18):
                    columns = dict(zip(part.schema.names, part.columns))
                    wanted = reach(columns, bounds)[1]
                    for i, home in enumerate(columns["home"].to_pylist()):
                        wanted[i, np.isin(numbers, home)] = False
                    at, to = np.nonzero(wanted)
                    for some in range(0, len(at), 4096):
                        few = part.take(pa.array(at[some : some + 4096]))
                        yield few.append_column("shard", pa.array(numbers[to[some : some + 4096]], pa.int32()))

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    parts = max(1, -(-queries.count() // QUERIES_PER_TASK))
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(index.shards * parts, MOST_TASKS))

    def meet(rows: DataFrame) -> DataFrame:
        """rows (queries with a shard) with the lists of their shards."""
        asked = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        held = index.lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got = visit(left, right) if len(left) and len(right) else {"key": [], "slot": [], "vec_id": [], "score": []}
            return pa.table({"key": pa.array(got["key"], pa.int64()), "slot": pa.array(got["slot"], pa.int32()), "vec_id": pa.array(got["vec_id"], pa.int64()), "score": pa.array(got["score"], pa.int64())})

        asked, held = (x.repartition(tasks, "shard", "part") for x in (asked, held))
        return asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(run, FOUND)

    start = queries.withColumn("floor", F.lit(None).cast("map<int,long>")).withColumn("home", F.array().cast("array<int>"))
    for low, high in chunks:
        start = routed(start, low, high)
    start = stored(start, "routed")
    first = stored(ranked(meet(start.withColumn("shard", F.explode("home"))), k).drop("rank"), "first-found")
    floors = ranked(first, k).where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))
    again = stored(start.drop("floor").join(floors, "key", "left").select(*start.columns), "floored")
    rest = union([further(again, low, high) for low, high in chunks])
    return ranked(first.unionByName(meet(rest)), k)
