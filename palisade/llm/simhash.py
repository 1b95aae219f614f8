"""SimHash near-duplicates: fingerprints of word shingles, and a binary-trie self-join under a Hamming error budget.

The join works on distinct fingerprints. If two differ in at most `budget` bits, at least one of budget + 1 blocks
of bits is equal in both, so each fingerprint goes once to each block's key and every key owns the part of the trie
below it; where a key has many rows, the bits left are cut into blocks again, until it has few. Inside a part,
pairs of trie nodes descend together one bit at a time; each pair carries the number of differing bits so far and
is dropped once that exceeds the budget. The budget rises from 1, and pairs of nodes that lie wholly in one
component found before are dropped, so that a dense cluster costs little more than its size. Links leave a part as
a star for each component found in it: no link between components is lost and no group is expanded into all pairs.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other; rows with a
null doc_id get the component of their fingerprint; repeated rows each get a row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import connected_components
from palisade.session import checkpointed, map_batches

SEED, BITS = 42, 64
#: Rows of a key above which it is split, how often, and rows of fingerprints that one task joins at a time.
MOST_ROWS, LEVELS, ROWS_PER_TASK = 4096, 4, 20_000


def shingle_hashes(text: str | None, shingle_words: int) -> list[int]:
    """The XXH64 of all word shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if len(words) < shingle_words:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, digest = (ends - sizes)[: len(words) - shingle_words + 1].tolist(), xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())]


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 if there are no words."""
    hashes = shingle_hashes(text, shingle_words)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        block = np.array(hashes[at : at + 8192], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "fp": np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def blocks(width: int, pieces: int) -> list[int]:
    return [width // pieces + (i < width % pieces) for i in range(pieces)]


def spread(rows: DataFrame, width: int, budget: int) -> DataFrame:
    """(key, fp, rep, rest) to budget + 1 rows each: a key is the key before, the place and the bits of the chosen block, and
    rest, of `width` bits, loses that block."""
    sizes, made, at = blocks(width, budget + 1), [], 0
    for i, size in enumerate(sizes):
        low = width - at - size  # bits below the block
        bits = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low) if at else F.lit(0).cast("long")
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        made.append(F.struct(F.xxhash64("key", F.lit(i), bits).alias("key"), above.bitwiseOR(below).alias("rest")))
        at += size
    return rows.select("fp", "rep", F.explode(F.array(*made)).alias("x")).select("x.key", "fp", "rep", "x.rest")


def components_of(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Least-index labels after joining a[i] with b[i]."""
    while True:
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
        if (labels[a] == labels[b]).all():
            return labels


def trie_components(keys: np.ndarray, fps: np.ndarray, budget: int, most_pairs: int = 1 << 19) -> np.ndarray:
    """Component labels of rows sorted by (key, fp), all distinct: rows of a key at Hamming distance <= budget are linked.

    A node at depth d is a run of rows with the same key and the same d leading bits."""
    n = len(fps)
    differ = fps[1:] ^ fps[:-1]
    shared = np.full(n, BITS + 1, np.int64)  # leading bits shared with the row before; -1 where the key is new
    top = np.zeros(n - 1, np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (differ >> np.uint64(shift)) != 0
        top[high] += shift
        differ = np.where(high, differ >> np.uint64(shift), differ)
    shared[1:] = np.where(keys[1:] != keys[:-1], -1, BITS - 1 - top)
    shared[0] = -1
    starts = [np.flatnonzero(shared < d) for d in range(BITS + 1)]
    labels = np.arange(n)
    for allowed in range(1, budget + 1):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        tops, uniform = np.arange(len(starts[0])), [None] * (BITS + 1)

        def one_label(depth: int, uniform: list = uniform) -> np.ndarray:
            """The label of each node whose rows have but one, else -1 - node."""
            if uniform[depth] is None:
                low, high = np.minimum.reduceat(labels, starts[depth]), np.maximum.reduceat(labels, starts[depth])
                uniform[depth] = np.where(low == high, low, -1 - np.arange(len(low)))
            return uniform[depth]

        stack = [(0, tops, tops, np.zeros(len(tops), np.int8))]
        while stack:
            depth, a, b, errors = stack.pop()
            if len(a) > most_pairs:
                half = len(a) // 2
                stack += [(depth, a[:half], b[:half], errors[:half]), (depth, a[half:], b[half:], errors[half:])]
                continue
            label = one_label(depth)
            alone = (label[a] == label[b]) & (label[a] >= 0)
            a, b, errors = a[~alone], b[~alone], errors[~alone]
            if not len(a):
                continue
            if depth == BITS:
                found.append((starts[BITS][a], starts[BITS][b]))
                continue
            here, below = starts[depth], starts[depth + 1]
            first = np.searchsorted(below, here)
            second = np.append(first[1:], len(below)) - first == 2
            bit = ((fps[below] >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int8)
            pairs = []
            for i in (0, 1):
                for j in (0, 1):
                    use = np.ones(len(a), bool)
                    if i:
                        use &= second[a]
                    if j:
                        use &= second[b]
                    if i > j:
                        use &= a != b
                    x, y = first[a[use]] + i, first[b[use]] + j
                    e = errors[use] + (bit[x] != bit[y])
                    ok = e <= allowed
                    pairs.append((x[ok], y[ok], e[ok]))
            stack.append((depth + 1, *map(np.concatenate, zip(*pairs))))
        if found:
            labels = components_of(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), labels)
    return labels


def trie_links(keyed: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) of the rows (key, fp, rep) of each key, of no more rows than one task holds."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key; whole keys are joined, about ROWS_PER_TASK rows at a time."""
        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pa.RecordBatch:
            key, fp, rep = (rows[c].to_numpy() for c in ("key", "fp", "rep"))
            order = np.lexsort((fp.view(np.uint64), key))
            key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
            labels = trie_components(key, fp, budget)
            least = rep.copy()
            np.minimum.at(least, labels, rep)
            far = least[labels] != rep
            return pa.RecordBatch.from_arrays([pa.array(least[labels][far]), pa.array(rep[far])], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(batch.to_pandas())
            size += len(held[-1])
            if size >= ROWS_PER_TASK:
                rows = pd.concat(held, ignore_index=True)
                rest = rows["key"].to_numpy() == rows["key"].iloc[-1]
                if not rest.all():
                    yield flush(rows[~rest])
                held, size = [rows[rest]], int(rest.sum())
        if held and (rows := pd.concat(held, ignore_index=True)).size:
            yield flush(rows)

    tasks = max(1, -(-keyed.count() // ROWS_PER_TASK))
    return keyed.select("key", "fp", "rep").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, rep), a row for each distinct fingerprint, to links (a, b) between reps that keep every component whole.

    A key with more than MOST_ROWS rows is split by blocks of the bits it has left, up to LEVELS times. What is above the
    bound then is a dense cluster, which further bits would not part; a task joins it as it is."""
    rows, width, found = fps.select(F.lit(0).cast("long").alias("key"), "fp", "rep", F.col("fp").alias("rest")), BITS, None
    for level in range(1, LEVELS + 1):
        rows = checkpointed(spread(rows, width, budget))
        width -= min(blocks(width, budget + 1))  # blocks differ by one bit, and the rest is kept in the wider one's width
        large = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select("key"))
        done = level == LEVELS or large.isEmpty()
        now = trie_links(rows if done else rows.join(large, "key", "left_anti"), budget)
        found = now if found is None else found.unionByName(now)
        if done:
            break
        rows = rows.join(large, "key", "left_semi")
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id that links reach."""
    prints = checkpointed(fingerprints(docs, shingle_words))
    fps = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(fps.where("rep IS NOT NULL"), budget))
    classes = fps.join(found, fps.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, budget: int = 4) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; rows with a null doc_id stay."""
    gone = near_duplicates(docs, shingle_words, budget).where("doc_id <> component_id").select(F.col("doc_id").alias("__palisade_gone"))
    return docs.join(gone, docs["doc_id"] == gone["__palisade_gone"], "left_anti")
