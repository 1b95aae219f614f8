"""Exact top-k search by inner product with block-at-a-time pruning.

The components of a vector are its terms. Documents are ordered by (cluster, vec_id) and cut into ranges, the blocks; a
block keeps, for each term, the highest and the lowest value of its documents, and a forward index of all their values.
For a query, the sum over its terms of the highest product that a block allows bounds all scores in the block; blocks
are visited in descending order of that sum, each scored as a whole through its forward index, until a block's bound
falls below the kth score found so far. Nothing is approximate: clusters decide only which documents share a block.

Defined results: vectors that are null, or that hold null or non-finite components, and rows without vec_id take no
part; an empty vector scores 0, and shorter vectors count as filled up with zeros; rows that carry the query's own
vec_id are its own, so no candidates; repeated rows are candidates (and queries) each; ties go to the smaller vec_id; scores
beyond the longs become the nearest long; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.vector_lists import EXACT, Index, build, exact_rows, matrix, products, quantised, search, vectors_of, whole_vectors
from palisade.session import stored

BLOCK_ROWS = 128
ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), flat AS (
  SELECT vec_id, unnest(range(len(q))) AS term, unnest(q) AS x FROM usable
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM flat a JOIN flat b ON a.term = b.term AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def extremes(vectors: np.ndarray, cluster: int, centers: np.ndarray) -> bytes:
    """The highest and the lowest value of each term."""
    return np.stack([vectors.max(0), vectors.min(0)]).astype("<i8").tobytes()


def whole_extremes(lists: list[tuple[int, bytes]]) -> bytes:
    both = np.stack([np.frombuffer(b, "<i8").reshape(2, -1) for _, b in lists])
    return np.stack([both[:, 0].max(0), both[:, 1].min(0)]).tobytes()


def summed_maxima(queries: np.ndarray, bounds: list[bytes]) -> np.ndarray:
    """Queries x blocks: no document of the block scores higher."""
    both = np.stack([np.frombuffer(b, "<i8").reshape(2, -1) for b in bounds]).astype(np.float64)
    q = queries.astype(np.float64)
    most = np.maximum(q, 0) @ both[:, 0].T + np.minimum(q, 0) @ both[:, 1].T
    size = np.abs(q) @ np.abs(both).max(1).T
    return most + np.where(size < EXACT, 0, 1e-9 * size)  # doubles are exact below


def top_k(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """queries (key, query_id, q), a stored table; (key, slot, vec_id, score, rank) of the k highest scores of each."""
    width = index.width

    def reach(columns: dict[str, pa.Array], bounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        most = summed_maxima(matrix(columns["q"], width), bounds)
        floor = [dict(x or ()).get(0) for x in columns["floor"].to_pylist()]
        return most, most >= np.array([-np.inf if x is None else float(x) for x in floor])[:, None]

    def visit(asked: pa.Table, blocks: pa.Table) -> dict[str, list]:
        ids = [np.array(x, np.int64) for x in blocks.column("ids").to_pylist()]
        q = matrix(asked.column("q").combine_chunks(), width)
        values = [exact_rows(v, float(np.abs(q.astype(np.float64)).max(initial=0))) for v in vectors_of(blocks, width)]
        bounds, out = blocks.column("bound").to_pylist(), {"key": [], "slot": [], "vec_id": [], "score": []}
        keys, floors, names = (asked.column(c).to_pylist() for c in ("key", "floor", "query_id"))
        for at in range(0, len(q), 1024):
            most = summed_maxima(q[at : at + 1024], bounds)
            order = np.argsort(-most, axis=1, kind="stable")
            for i, (bound, blocks_by_bound) in enumerate(zip(most, order), at):
                kth = dict(floors[i] or ()).get(0)
                scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
                query = q[i].astype(np.float64)
                for b in blocks_by_bound:
                    if kth is not None and bound[b] < kth:
                        break  # and so do all that follow
                    s = products(values[b], query if values[b].dtype == np.float64 else q[i])
                    keep = ids[b] != names[i]
                    if kth is not None:
                        keep &= s >= kth
                    if not keep.any():
                        continue
                    scores, found = np.append(scores, s[keep]), np.append(found, ids[b][keep])
                    best = np.lexsort((found, ~scores))[:k]  # ~ turns the order round and can't overflow
                    scores, found = scores[best], found[best]
                    if len(scores) == k:
                        kth = int(scores[-1])
                out["key"] += [keys[i]] * len(found)
                out["slot"] += [0] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return out

    return search(queries, index, reach, visit, k)


def exact_search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors (vec_id, embedding); rows where is_query holds are queries against all."""
    rows = vectors.where(F.col("vec_id").isNotNull() & whole_vectors(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("q"), is_query.alias("asked"))
    index = build(rows, BLOCK_ROWS, extremes, whole_extremes)
    queries = rows.where("asked").select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("query_id"), "q")
    queries = stored(queries, "queries")
    found = top_k(queries, index, k)
    return found.join(queries.select("key", "query_id"), "key").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
