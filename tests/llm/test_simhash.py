"""SimHash near duplicates against a bit-by-bit fingerprint and all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import simhash
from tests.llm.conftest import ROWS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids, budget):
    """Least id reachable by links of all pairs."""
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= budget and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def check(frame, rows, size=4, budget=4):
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame, size, budget).where("doc_id IS NOT NULL").collect())
    rows = [(i, slow_fingerprint(t, size)) for i, t in rows if i is not None]
    distinct = {}
    for i, fp in rows:
        distinct[fp] = min(i, distinct.get(fp, i))
    of = dict(zip(distinct, slow_components(list(distinct), list(distinct.values()), budget)))
    assert got == sorted((i, fp, of[fp]) for i, fp in rows)


def test_tables(docs, sample):
    check(docs, [(i, t) for i, t, *_ in sample])


def test_edge_rows(edge, empty):
    check(edge, [r[:2] for r in ROWS])
    assert simhash.near_duplicates(edge).count() == len(ROWS)
    assert simhash.near_duplicates(empty).count() == 0


def clustered(seed, n, flips):
    """Fingerprints in clusters whose members differ by a few bits, some exactly at and just over the budget."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fp = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                fp ^= 1 << b
            out.add(fp)
            if rng.random() < 0.3:
                base = fp
    return sorted(out)


def test_trie_join_finds_what_all_pairs_find():
    for seed, budget in ((1, 4), (2, 3), (3, 1), (4, 6)):
        fps = clustered(seed, 300, budget + 2)
        labels = simhash.trie_components(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), budget)
        assert labels.tolist() == slow_components(fps, list(range(len(fps))), budget)


def test_every_level_of_blocks_brings_near_pairs_together(spark):
    fps = clustered(5, 250, 5)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long").cache()
    near = {(j, i) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    keyed, width = frame.selectExpr("0L AS key", "fp", "rep", "fp AS rest"), 64
    for _ in range(3):
        keyed = simhash.spread(keyed, width, 4)
        width -= min(simhash.blocks(width, 5))
        met = keyed.alias("a").join(keyed.alias("b"), "key").where("a.rep < b.rep").select("a.rep", "b.rep").distinct().collect()
        assert near <= {tuple(r) for r in met}


@pytest.mark.parametrize("most", [4096, 8])
def test_links_keep_components_whole(spark, monkeypatch, most):
    """Also where every key has too many rows and is split again."""
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    fps = clustered(6, 400 if most > 8 else 120, 6)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    found = {r.id: r.component for r in simhash.connected_components(simhash.links(frame, 4)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == slow_components(fps, list(range(len(fps))), 4)


def test_filter_keeps_columns_and_one_of_each(edge, docs):
    left = simhash.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    assert left.where("doc_id IS NULL").count() == 2
    assert left.where("doc_id IN (3, 4, 5)").select(F.min("doc_id"), F.count("*")).first() == (3, 1)
    once = simhash.drop_near_duplicates(docs)
    groups = simhash.near_duplicates(docs, 5).select("component_id").distinct().count()
    assert once.count() == groups
