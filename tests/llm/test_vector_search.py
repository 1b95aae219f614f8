"""Exact top-k search and hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import exact_topk, hard_negatives, vector_lists

SCHEMA = "vec_id long, embedding array<float>, label int"
BIG = (1 << 63) - 1


def whole(rows, scale):
    """(vec_id, label, integers) of the rows that take part."""
    out = []
    for i, v, y in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, y, [max(-BIG - 1, min(BIG, math.floor(scale * float(np.float32(x))))) for x in v]))
    return out


def inner(a, b):
    return max(-BIG - 1, min(BIG, sum(x * y for x, y in zip(a, b))))


def slow_topk(rows, every, k, scale=1024):
    rows, out = whole(rows, scale), []
    for i, _, q in rows:
        if i % every == 0:
            best = sorted((-inner(q, x), j) for j, _, x in rows if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def slow_negatives(rows, every, scale=256):
    rows, out = [x for x in whole(rows, scale) if x[1] is not None], []
    for i, y, q in rows:
        if i % every == 0:
            scores = [(-inner(q, x), j, z) for j, z, x in rows]
            for s, j in sorted((s, j) for s, j, z in scores if z == y and j != i)[:5]:
                near = sorted((t, n) for t, n, z in scores if z != y and 50 * -s <= 100 * -t <= 95 * -s)[:3]
                out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(near, 1)]
    return sorted(out)


def clustered(seed, n=400, dims=6, tight=0.1):
    """Vectors in a few tight heaps, a third of them in one; many equal ones, so that scores tie."""
    rng = random.Random(seed)
    hearts = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        heart = hearts[0] if rng.random() < 0.33 else rng.choice(hearts)
        rows.append((i, [float(np.float32(x + rng.choice([0, 0, tight, -tight]))) for x in heart], rng.randint(0, 3)))
    rng.shuffle(rows)
    return rows


EDGE = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.25, 0.5], 2), (10, None, 1), (20, [None, 1.0], 1), (30, [float("nan"), 1.0], 1), (40, [float("inf"), 1.0], 1),
    (None, [1.0, 1.0], 1), (50, [], 3), (60, [1.0], None), (70, [2.0, 1.0, -3.0], 1), (1, [1.0, 0.5], 2), (2, [1.0, 0.5], 1), (3, [0.9, 0.5], 2), (4, [-1.0, -1.0], 1),
    (5, [0.7, 0.5], 2), (6, [0.7, 0.5], 4), (7, [0.6, 0.5], 2), (8, [0.0, 0.0], 1), (9, [0.0], 2),
]
GIANTS = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate([[3e38, 1], [-3e38, 2], [1e15, 1e15], [1e15, -1e15], [7e6, 9e6], [1, 1], [5e8, 4e8], [5e8, 4e8], [0, 0]])]


def top(frame, every, k=10):
    return sorted(tuple(r) for r in exact_topk.exact_search(frame, F.col("vec_id") % every == 0, k).collect())


def negatives(frame, every):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % every == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered(spark, monkeypatch, seed):
    """Small lists, several chunks of shard bounds and several parts of queries."""
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", 11)
    monkeypatch.setattr(vector_lists, "QUERIES_PER_TASK", 9)
    if seed == 2:
        monkeypatch.setattr(vector_lists, "BOUND_BYTES", 500)
    rows = clustered(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert top(frame, 7) == slow_topk(rows, 7, 10)
    got, want = negatives(frame, 9), slow_negatives(rows, 9)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("rows", [EDGE, GIANTS], ids=["edge", "giants"])
def test_edge_rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.select("*", *[F.lit("x").alias(c) for c in ("q", "key", "slot", "score", "shard", "part", "home", "floor", "cluster", "rank", "asked", "ids")])
    assert top(clash, 1, 3) == slow_topk(rows, 1, 3)
    assert top(frame, 10) == slow_topk(rows, 10, 10)
    assert negatives(clash, 1) == slow_negatives(rows, 1)


def test_few_rows(spark):
    for rows in ([], [(0, None, None)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert top(spark.createDataFrame(rows, SCHEMA), 1) == slow_topk(rows, 1, 10)
    for rows in ([], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert negatives(spark.createDataFrame(rows, SCHEMA), 1) == []


def test_bounds_hold_and_prune():
    """No score passes a bound, and tight heaps are skipped."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 400, (6, 8))
    lists = [np.rint(c + rng.normal(0, 9, (20, 8))).astype(np.int64) for c in centers]
    q = np.concatenate([x[:2] for x in lists])
    most = exact_topk.summed_maxima(q, [exact_topk.extremes(x, 0, centers) for x in lists])
    low, high = hard_negatives.score_ranges(q, np.stack([np.frombuffer(hard_negatives.ball(x, i, centers)) for i, x in enumerate(lists)]), centers)
    for b, x in enumerate(lists):
        scores = q @ x.T
        assert (scores.max(1) <= most[:, b]).all() and (scores.max(1) <= high[:, b]).all() and (scores.min(1) >= low[:, b]).all()
    kth = np.sort(np.concatenate([q @ x.T for x in lists], axis=1), axis=1)[:, -10][:, None]
    assert (most < kth).mean() > 0.5 and (high < kth).mean() > 0.5


def test_wide_shards_are_split(spark):
    """A cluster of any size lies in lists of bounded length."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("label"), F.array(F.lit(1).cast("long"), F.col("id") % 2).alias("q"))
    index = vector_lists.build(rows, 64, exact_topk.extremes, exact_topk.whole_extremes)
    sizes = [len(r.ids) for r in index.lists.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 64
    assert sorted(i for r in index.lists.collect() for i in r.ids) == list(range(3000))
