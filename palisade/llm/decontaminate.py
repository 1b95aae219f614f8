"""Benchmark decontamination: every passage of every training document is a BM25 query against an inverted index of
the test items, answered by block-max WAND; what it retrieves is verified by question and answer overlap.

Index: for each term the posting list of items in ascending order, and the term's largest impact in each block of BLOCK
neighbouring items. An impact is the term's BM25 weight in the item divided by the item's score for itself, so that a
score is the share of an item that a passage holds, and one threshold fits short and long items.
Query: the distinct terms of a passage. The block maxima of a passage's terms add up to a bound for each block; blocks
below the threshold are dead for the passage (this is worked out for many passages of a document at once, in a table of
halves of passages by blocks, and for terms that stand in many items the largest sum in the block is taken). The document-at-a-time search (WAND: pivots by
largest impacts, then by the maxima of the pivot's block) moves through live blocks alone, so nothing is lost.
Items are indexed by classes of length, up to CLASS_WORDS words and four times as many for each further class. The passages of a
class are twice as long as its longest item and start every half of that, so each item stands whole in one, and one very
long item widens the passages of its like alone.
Verification: the item's last sentence is its answer and the rest its question; of each, the share of the runs of
SHINGLE words found in the passage, or of the words in the best alignment with a piece of it, must reach OVERLAP (an
item of one sentence is all question, and a part of fewer words than SHINGLE is one run). One changed word breaks up to
SHINGLE runs but costs the alignment one word; a gap or swapped pieces cost the runs few.

Document frequencies, the mean length and the longest item of each class are worked out by Spark over the whole benchmark, so an
item's score doesn't depend on its shard. Items lie in shards of about SHARD_ITEMS items (or SHARD_TERMS words) in the shared
folder, so each shard has a size bound. A pass over the documents takes PASS_SHARDS of them: they are broadcast, each worker process builds
their indexes once, and the broadcast is released when the pass has written what it found. Larger benchmarks take further passes.

Defined results: null or empty texts and items without words match nothing; repeated items or documents match as
often as they stand; rows with a null doc_id are scanned, and are never removed by `drop_contaminated`; empty tables
give an empty result (no documents) or no matches (no items); further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import map_batches, shared_path, slices, stored

K1, B = 1.2, 0.75
BLOCK, SHINGLE, OVERLAP, MIN_SCORE = 8, 5, 0.8, 0.6
SHARD_ITEMS, SHARD_TERMS, PASS_SHARDS = 20_000, 2_000_000, 1
#: Words of the items in the first class of lengths; numbers of the table of halves by blocks that are held at a time.
CLASS_WORDS, TABLE = 256, 1 << 21
#: A term in more than this share of the items can't tell them apart: its impact goes into the bound alone.
COMMON_SHARE = 0.02

KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z in lower case; other characters below 128 part words."""
    return (text or "").encode().translate(KEEP).split()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: all but the last sentence, and the last one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text or "") if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def runs(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def share(part: list[bytes], passage: list[bytes]) -> float:
    """How much of part the passage holds: the share of its runs found there, or of its words in the best alignment with a
    piece of the passage (1 - edits / words), whichever is more; 1 for an empty part."""
    want = runs(part)
    if not want or not passage:
        return float(not want)
    have = runs(passage, min(SHINGLE, len(part)))
    found = sum(r in have for r in want) / len(want)
    return found if found == 1 else max(found, 1 - edits_to_piece(part, passage) / len(part))


def edits_to_piece(part: list[bytes], passage: list[bytes]) -> int:
    """Least number of words to change, add or drop that turns part into some piece of the passage (Myers 1999, bit-parallel)."""
    places: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(part):
        places[w] |= 1 << i
    every, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
    plus, minus, now = every, 0, len(part)
    best = now
    for w in passage:
        equal = places.get(w, 0)
        vertical = equal | minus
        across = ((((equal & plus) + plus) ^ plus) | equal) & every
        up, down = (minus | ~(across | plus)) & every, plus & across
        now += bool(up & last) - bool(down & last)
        best = min(best, now)
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = (down | ~(vertical | up)) & every, up & vertical
    return best


class Stats(NamedTuple):
    """Number of items, mean length in words, greatest length in each class, and in how many items each term stands."""

    n: int
    mean: float
    longest: dict[int, int]
    df: dict[bytes, int]


def length_class(n: int) -> int:
    k = 0
    while n > CLASS_WORDS << 2 * k:
        k += 1
    return k


def stats_of(items: list[tuple[int, str]]) -> Stats:
    lists = [w for _, t in items if (w := words_of(t))]
    longest: dict[int, int] = {}
    for w in lists:
        longest[length_class(len(w))] = max(len(w), longest.get(length_class(len(w)), 0))
    return Stats(len(lists), sum(map(len, lists)) / max(1, len(lists)), longest, Counter(t for w in lists for t in set(w)))


def indexes(items: list[tuple[int, str]], stats: Stats) -> list[Index]:
    """An index for each class of lengths that the items have."""
    classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for item in items:
        classes[length_class(len(words_of(item[1])))].append(item)
    return [Index(own, stats, stats.longest.get(k, 0)) for k, own in sorted(classes.items())]


class Index:
    """Inverted index of items (item_id, text) of one class of lengths. stats and longest are those of all items, if these are but some."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None, longest: int | None = None) -> None:
        stats = stats or stats_of(items)
        self.items = [(i, t, words_of(t)) for i, t in items if words_of(t)]
        self.halves = [halves(t) for _, t, _ in self.items]
        n = len(self.items)
        idf = {t: float(np.log(1 + (stats.n - d + 0.5) / (d + 0.5))) for t, d in stats.df.items()}
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, _, words) in enumerate(self.items):
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / stats.mean)
            weights = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in counts.items()}
            own = sum(weights.values())
            for t, w in weights.items():
                lists[t].append((at, w / own))
        order = sorted(lists)
        self.terms = {t: i for i, t in enumerate(order)}
        self.lists = [([d for d, _ in lists[t]], [w for _, w in lists[t]]) for t in order]
        self.term_max = [max(w) for _, w in self.lists]
        # By term, the blocks that it stands in and its largest impact in each.
        self.blocks: list[dict[int, float]] = []
        for p, w in self.lists:
            most: dict[int, float] = {}
            for d, x in zip(p, w):
                most[d // BLOCK] = max(x, most.get(d // BLOCK, 0.0))
            self.blocks.append(most)
        # Flat block maxima of the telling terms; for each block, what common terms can add to one of its items at most.
        telling = [len(p) <= max(4, COMMON_SHARE * n) for p, _ in self.lists]
        self.sizes = np.array([len(m) if tell else 0 for m, tell in zip(self.blocks, telling)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = [x for m, tell in zip(self.blocks, telling) if tell for x in sorted(m.items())]
        self.flat_blocks, self.flat_max = np.array([k for k, _ in flat], np.int64), np.array([w for _, w in flat], float)
        common = np.zeros(n)
        for (p, w), tell in zip(self.lists, telling):
            if not tell:
                common[p] += w
        self.n_blocks = -(-n // BLOCK)
        self.common = np.array([common[k * BLOCK : (k + 1) * BLOCK].max() for k in range(self.n_blocks)])
        self.longest = max(stats.longest.values(), default=0) if longest is None else longest

    def live_blocks(self, ids: np.ndarray, step: int, threshold: float) -> dict[int, list[int]]:
        """By passage (words number * step to (number + 2) * step), the blocks whose maxima add up to the threshold. ids: each
        word's term, -1 if none. A term counts once in each half of a passage, so sums are upper bounds."""
        halves, out = -(-len(ids) // step), {}
        most = max(1, TABLE // max(self.n_blocks, 1))
        for first in range(0, halves, most):
            last = min(first + most + 1, halves)  # with the second half of the last passage
            own = ids[first * step : last * step]
            at = np.flatnonzero(own >= 0)
            half, terms = np.divmod(np.unique(at // step * len(self.sizes) + own[at]), max(len(self.sizes), 1))
            sizes = self.sizes[terms]
            ends = np.cumsum(sizes)
            flat = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(self.offsets[terms], sizes)
            cells = np.repeat(half, sizes) * self.n_blocks + self.flat_blocks[flat]
            table = np.bincount(cells, self.flat_max[flat], (last - first) * self.n_blocks).reshape(last - first, self.n_blocks)
            both = table[: min(most, halves - first)] + self.common
            both[: len(table) - 1] += table[1 : len(both) + 1]  # a passage is two neighbouring halves
            for p, k in zip(*(x.tolist() for x in np.nonzero(both >= threshold - 1e-9))):
                out.setdefault(first + p, []).append(k)
        return out

    def search(self, terms: list[int], threshold: float, live: list[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) of at least the threshold for a query of distinct terms; live: the blocks to look in."""
        live = list(range(self.n_blocks)) if live is None else live
        at = [[self.lists[t][0][0], 0, t] for t in terms]  # current item, place in the list, term
        out = []
        eps = 1e-9
        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(at):
                bound += self.term_max[t]
                if bound >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            block, k = item // BLOCK, bisect_left(live, item // BLOCK)
            if k == len(live):
                break
            if live[k] != block:
                target = live[k] * BLOCK  # on to the next live block
            elif sum(self.blocks[t].get(block, 0.0) for _, _, t in at[: pivot + 1]) < threshold - eps:
                # No item up to the end of the block, or the next list's item, can reach the threshold.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(at):
                    target = max(min(target, at[pivot + 1][0]), item + 1)
            elif at[0][0] == item:
                score = sum(self.lists[t][1][place] for _, place, t in at[: pivot + 1])
                if score >= threshold - eps:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            kept = []
            for doc, place, t in at:
                if doc < target:
                    place = bisect_left(self.lists[t][0], target, place)
                    if place == len(self.lists[t][0]):
                        continue
                    doc = self.lists[t][0][place]
                kept.append([doc, place, t])
            at = kept
        return out

    def matches(self, text: str | None, threshold: float = MIN_SCORE, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question share, answer share) of verified items, each once with its best passage."""
        words = words_of(text)
        if not self.items or not words:
            return []
        step = self.longest
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        found: dict[int, tuple[int, float, float, float]] = {}
        for p, live in self.live_blocks(ids, step, threshold).items():
            lo, hi = p * step, (p + 2) * step
            for item, score in self.search(sorted({t for t in ids[lo:hi].tolist() if t >= 0}), threshold, live):
                question, answer = self.halves[item]
                q, a = share(question, words[lo:hi]), share(answer, words[lo:hi])
                if q >= overlap and a >= overlap and (item not in found or score > found[item][1]):
                    found[item] = (self.items[item][0], float(score), q, a)
        return [found[i] for i in sorted(found)]


def index_shards(benchmark: DataFrame) -> tuple[Stats, DataFrame]:
    """Stats of all items (df left out), and the shards: (shard, items, df), df for the shard's own terms."""
    spark = benchmark.sparkSession

    def run(ids: list, texts: list) -> dict:
        lists = [words_of(t) for t in texts]
        return {"item_id": ids, "text": texts, "n": list(map(len, lists)), "class": [length_class(len(w)) for w in lists], "terms": [sorted(set(w)) for w in lists]}

    items = map_batches(benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL"), run, "item_id long, text string, n long, class int, terms array<binary>").where("n > 0")
    path = shared_path(spark, "benchmark-items")
    items.write.parquet(path)
    items = spark.read.parquet(path)
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    longest = {r["class"]: r.longest for r in items.groupBy("class").agg(F.max("n").alias("longest")).collect()}  # a row for each class
    shards = max(1, -(-n // SHARD_ITEMS), -(-total // SHARD_TERMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    terms = dealt.select("shard", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.distinct().join(df, "term").groupBy("shard").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    held = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    path = shared_path(spark, "benchmark-shards")
    held.join(known, "shard").write.parquet(path)
    return Stats(n, total / max(1, n), longest, {}), spark.read.parquet(path)


_INDEX: dict[str, list[Index]] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_SCORE, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question, answer): a row for each verified item of each document."""
    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, items array<struct<item_id: long, score: double, question: double, answer: double>>"
    match = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(match))])
    stats, shards = index_shards(benchmark)

    def scan(sent: list[tuple[str, object]]) -> DataFrame:
        """One pass over the documents, for a few shards."""

        def opened() -> list[Index]:
            """The indexes of this pass, made once in each worker process; those of another pass go."""
            if set(_INDEX) != {name for name, _ in sent}:
                _INDEX.clear()
                for name, shard in sent:
                    items, df = shard.value
                    _INDEX[name] = indexes(items, stats._replace(df=df))
            return [index for name, _ in sent for index in _INDEX[name]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (x for batch in batches for x in slices(batch)):
                ids, texts = (c.to_pylist() for c in part.columns)
                got = [[m for index in opened() for m in index.matches(text, threshold, overlap)] for text in texts]
                hits = [i for i, found in enumerate(got) if found]
                items = [[dict(zip(("item_id", "score", "question", "answer"), m)) for m in got[i]] for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hits], pa.int64()), pa.array(items, arrow.field(1).type)], schema=arrow)

        return rows.mapInArrow(run, schema)

    found, sent, left = spark.createDataFrame([], schema), [], shards.count()
    only = left <= PASS_SHARDS
    for r in shards.toLocalIterator():  # one bounded shard at a time on its way to the executors
        df = {bytes(t.term): t.df for t in r.df}
        sent.append((uuid.uuid4().hex, spark.sparkContext.broadcast(([(i.item_id, i.text) for i in r.items], df))))
        left -= 1
        if len(sent) == PASS_SHARDS or not left:
            if only:
                found = scan(sent)  # one pass can wait until its rows are asked for
            else:
                found = found.unionByName(stored(scan(sent), "contaminated"))
                for _, shard in sent:
                    shard.destroy()
            sent = []
    return found.select("doc_id", F.explode("items").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("__palisade_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__palisade_gone"], "left_anti")
