"""Hard-negative mining by exact searches in k-means inverted lists with stored radii.

A list holds vectors of one k-means cluster, its centroid c and the radius r, the largest distance of its members from c. By
Cauchy and Schwarz all scores q.x of the list lie within |q| r of q.c. For an anchor, lists are visited in descending
order of the upper bound; a list whose range of scores lies outside the window is skipped, and the search stops when the
bound falls strictly below the kth score, so that ties are still seen. Positives are a search with an open window among rows of the anchor's
label; their scores make the windows in which negatives are searched among rows of other labels, all windows of an anchor at once.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; shorter vectors
count as filled up with zeros; rows that carry the anchor's vec_id aren't its positives; repeated rows each take
part, as anchors too; ties go to the smaller vec_id; scores beyond the longs become the nearest long; an anchor without
positives, or a positive without negatives in its window, gives no row, and so does an empty table; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.vector_lists import LONGS, Index, build, exact_rows, matrix, products, quantised, search, vectors_of, whole_vectors
from palisade.session import stored

LIST_ROWS = 512
ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), flat AS (
  SELECT vec_id, label, unnest(range(len(q))) AS term, unnest(q) AS x FROM usable
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM flat a JOIN flat b ON a.term = b.term AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id, a.label = b.label
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""


def ball(vectors: np.ndarray, cluster: int, centers: np.ndarray) -> bytes:
    """The cluster's number and the largest distance of a member from the centroid."""
    radius = float(np.sqrt(((vectors - centers[cluster]) ** 2).sum(1).max()))
    return np.array([cluster, radius]).tobytes()


def balls(lists: list[tuple[int, bytes]]) -> bytes:
    """Of a shard: each cluster that it holds with the largest radius of its lists."""
    radii: dict[int, float] = {}
    for cluster, about in lists:
        radii[cluster] = max(radii.get(cluster, 0.0), float(np.frombuffer(about)[1]))
    return np.array([x for pair in radii.items() for x in pair], np.float64).tobytes()


def score_ranges(q: np.ndarray, pairs: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, queries x lists, of the scores in lists (cluster, radius); wider than the rounding of doubles."""
    q, c = q.astype(np.float64), centers[pairs[:, 0].astype(int)]
    long = np.sqrt((q**2).sum(1))[:, None]
    middle, reach = q @ c.T, long * pairs[:, 1]
    reach = reach + 1e-9 * (np.abs(middle) + reach + long * np.sqrt((c**2).sum(1))) + 1e-6
    return middle - reach, middle + reach


def windows_of(slots: list[dict] | None, floors: list | None) -> list[tuple[int, int, int]]:
    """(slot, lowest, highest score) that still count."""
    known = dict(floors or ())
    return [(s["slot"], max(s["low"], known.get(s["slot"], s["low"])), s["high"]) for s in slots or ()]


def mined(queries: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """queries (key, anchor_id, label, q, slots), a stored table, slots being windows (slot, low, high) of scores:
    (key, slot, vec_id, score, rank) of the k highest scores in each window, of rows with the same or with another label."""
    width, centers = index.width, index.centers

    def reach(columns: dict[str, pa.Array], bounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [np.frombuffer(b).reshape(-1, 2) for b in bounds]
        starts = np.cumsum([0, *map(len, pairs[:-1])])
        low, high = score_ranges(matrix(columns["q"], width), np.concatenate(pairs), centers)
        windows = [windows_of(*x) for x in zip(columns["slots"].to_pylist(), columns["floor"].to_pylist())]
        wanted = np.stack([np.any([(high[i] >= a) & (low[i] <= b) for _, a, b in w] or [np.zeros(high.shape[1], bool)], axis=0) for i, w in enumerate(windows)])
        return np.maximum.reduceat(high, starts, axis=1), np.logical_or.reduceat(wanted, starts, axis=1)

    def visit(asked: pa.Table, lists: pa.Table) -> dict[str, list]:
        ids, labels = ([np.array(x, np.int64) for x in lists.column(c).to_pylist()] for c in ("ids", "labels"))
        q = matrix(asked.column("q").combine_chunks(), width)
        values = [exact_rows(v, float(np.abs(q.astype(np.float64)).max(initial=0))) for v in vectors_of(lists, width)]
        pairs = np.stack([np.frombuffer(b) for b in lists.column("bound").to_pylist()])
        keys, names, own, slots, floors = (asked.column(c).to_pylist() for c in ("key", "anchor_id", "label", "slots", "floor"))
        out = {"key": [], "slot": [], "vec_id": [], "score": []}
        for at in range(0, len(q), 1024):
            low, high = score_ranges(q[at : at + 1024], pairs, centers)
            order = np.argsort(-high, axis=1, kind="stable")
            for i in range(at, min(at + 1024, len(q))):
                state = [[a, b, np.empty(0, np.int64), np.empty(0, np.int64), slot] for slot, a, b in windows_of(slots[i], floors[i])]
                query, under, over = q[i].astype(np.float64), low[i - at], high[i - at]
                least = min((x[0] for x in state), default=None)
                for b in order[i - at]:
                    if least is None or over[b] < least:
                        break  # strictly below the kth score of every window, as are all that follow
                    live = [x for x in state if over[b] >= x[0] and under[b] <= x[1]]
                    if not live:
                        continue  # outside every window
                    s = products(values[b], query if values[b].dtype == np.float64 else q[i])
                    right = (labels[b] == own[i]) & (ids[b] != names[i]) if same else labels[b] != own[i]
                    for x in live:
                        take = right & (s >= x[0]) & (s <= x[1])
                        if take.any():
                            scores, found = np.append(x[2], s[take]), np.append(x[3], ids[b][take])
                            best = np.lexsort((found, ~scores))[:k]  # ~ turns the order round and can't overflow
                            x[2], x[3] = scores[best], found[best]
                            if len(best) == k:
                                x[0] = max(x[0], int(x[2][-1]))
                    least = min(x[0] for x in state)
                for _, _, scores, found, slot in state:
                    out["key"] += [keys[i]] * len(found)
                    out["slot"] += [slot] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += scores.tolist()
        return out

    return search(queries, index, reach, visit, k)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    A negative's score lies between `low` and `high` per cent of its positive's."""
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole_vectors(F.col("embedding")))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("q"), is_anchor.alias("asked"))
    index = build(usable, LIST_ROWS, ball, balls)
    open_window = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LONGS[0]).alias("low"), F.lit(LONGS[1]).alias("high")))
    anchors = stored(usable.where("asked").select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("anchor_id"), "label", "q", open_window.alias("slots")), "anchors")
    positives = stored(mined(anchors, index, n_positives, same=True), "positives")
    # Whole numbers only: low per cent of a score rounded up, high per cent rounded down.
    wide = F.col("score").cast("decimal(24,0)")
    window = F.struct(
        F.col("rank").cast("int").alias("slot"),
        F.ceil(wide * low / 100).cast("long").alias("low"),
        F.floor(wide * high / 100).cast("long").alias("high"),
    )
    windows = positives.groupBy("key").agg(F.collect_list(window).alias("slots"))  # n_positives at most
    found = mined(stored(anchors.drop("slots").join(windows, "key"), "windows"), index, n_negatives, same=False)
    pairs = positives.select("key", F.col("rank").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives = found.select("key", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return anchors.select("key", "anchor_id").join(pairs, "key").join(negatives, ["key", "slot"]).drop("key", "slot")
