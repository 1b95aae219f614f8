"""Substring dedup with prefix-partitioned suffix trees: words covered by a run of WINDOW words that also starts in a
document with a smaller doc_id are removed.

Suffixes are dealt to trees by prefixes of variable length. The run of WINDOW words at the start of a suffix holds a
least GRAM-word run (by hash, the leftmost if several are least), its anchor, and the suffix is dealt by the prefix
that ends in this anchor; suffixes with equal WINDOW words have equal prefixes. About twenty neighbouring suffixes share
an anchor, so they travel together as one segment of text. Prefixes that stand in one document only can't start a
repeat and go before any text moves; equal segments are then one segment with its least doc_id, so that a text copied
thousands of times is handled once. The suffixes of each prefix are counted: where they are more than a tree's memory
holds (GROUP_SEGMENTS segments), the prefix is lengthened. A segment is cut into shorter runs of suffixes (RUNS), and
each is dealt by all the words that its windows have in common, the more the shorter the run: at a run of one suffix
this is the whole window, of which there is one segment. So every group fits, by the same steps at every size.

A group's tree is its suffix array with the longest common prefixes of neighbours, whose intervals are the internal
nodes. The topmost nodes of a depth of WINDOW words or more are the maximal repeats' windows: a node gives the
suffixes below it its least doc_id.

Words are compared by 64-bit hashes within prefixes and by themselves within trees; segments are told apart by 128-bit
hashes.

Defined results: a null or empty text has no words; a doc_id on several rows is one document, each row judged
against the documents with smaller ids; rows with a null doc_id lose nothing and take nothing from others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import map_batches, stored

WINDOW, GRAM = 50, 8
#: Segments of a prefix that one tree may hold, and segments that a task handles at a time.
GROUP_SEGMENTS, TASK_SEGMENTS = 4096, 8192
#: Suffixes of a segment as its prefix is lengthened.
RUNS = (11, 3, 1)
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes part at exactly the white space of the contract


def anchor_runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first suffix, number of suffixes, anchor's place) of the runs of suffixes that share an anchor."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    weights = np.cumprod(np.full(gram, BASE, np.uint64))
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams += hashes[j : n - gram + 1 + j] * weights[j]
    grams = mixed(grams)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)
    at = least + np.arange(len(least))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]].view(np.int64), first, np.diff(np.append(first, len(at))), at[first]


def words_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def survey(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, n_words, sha256, runs) of each row; text_key tells rows with the same doc_id apart."""

    def run(ids: list, texts: list) -> dict:
        out: dict = {"doc_id": ids, "text_key": [], "n_words": [], "sha256": [], "runs": []}
        for doc_id, text in zip(ids, texts):
            words = split_words(text)
            out["text_key"].append(text_key(text))
            out["n_words"].append(len(words))
            out["sha256"].append(words_digest(words))
            parts = [x.tolist() for x in anchor_runs(words, window, gram)] if doc_id is not None else [[], [], [], []]
            out["runs"].append([{"anchor": a, "first": f, "n": n, "at": at} for a, f, n, at in zip(*parts)])
        return out

    return map_batches(docs, run, "doc_id long, text_key long, n_words long, sha256 string, runs array<struct<anchor: long, first: int, n: int, at: int>>")


def text_key(text: str | None) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest((text or "").encode())).view(np.int64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def halves(digest: int) -> tuple[int, int]:
    return signed(digest >> 64), signed(digest & (1 << 64) - 1)


def segments(held: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Rows of held (doc_id, text_key, text, runs) to a row for each run: (doc_id, text_key, first, key, pos, g1, g2) and, if
    asked for, its words; key is its anchor, and pos the anchor's place in the segment."""

    def run(ids: list, keys: list, texts: list, runs: list) -> dict:
        out: dict = {c: [] for c in ("doc_id", "text_key", "first", "key", "pos", "g1", "g2", "words")}
        for doc_id, key, text, of in zip(ids, keys, texts, runs):
            words = split_words(text)
            for r in of:
                part = b" ".join(words[r["first"] : r["first"] + r["n"] + window - 1])
                g1, g2 = halves(xxhash.xxh3_128_intdigest(part))
                for c, v in (("doc_id", doc_id), ("text_key", key), ("first", r["first"]), ("key", r["anchor"]), ("pos", r["at"] - r["first"]), ("g1", g1), ("g2", g2)):
                    out[c].append(v)
                if with_text:
                    out["words"].append(part.decode())
        return out

    return map_batches(held.select("doc_id", "text_key", "text", "runs"), run, "doc_id long, text_key long, first int, key long, pos int, g1 long, g2 long" + ", words string" * with_text)


def shorter(large: DataFrame, window: int, most: int) -> DataFrame:
    """(key, pos, g1, g2, words, low, high) to its pieces of at most `most` suffixes, dealt by their places before the anchor:
    (p1, p2, skip, ...) with the segment they come from, the suffixes before them and their own key and hashes. The key is
    that of the words that all windows of a whole piece have in common."""

    def run(keys: list, poses: list, g1: list, g2: list, texts: list, lows: list, highs: list) -> dict:
        names = ("p1", "p2", "skip", "key", "pos", "g1", "g2", "words", "low", "high")
        rows = []
        for key, pos, a, b, text, low, high in zip(keys, poses, g1, g2, texts, lows, highs):
            words = text.encode().split(b" ")
            at, n = 0, len(words) - window + 1
            while at < n:
                end = min(n, at + (pos - at) % most + 1)  # to the last suffix with as many whole pieces before the anchor
                piece = (pos - at) // most
                last = pos - piece * most  # a whole piece ends with this suffix, whether or not this segment has it
                part, common = b" ".join(words[at : end + window - 1]), b" ".join(words[last : last - most + 1 + window])
                mark = xxhash.xxh3_64_intdigest(common, seed=piece)
                rows.append((a, b, at, int((np.uint64(mark) ^ np.int64(key).view(np.uint64)).view(np.int64)), pos - at, *halves(xxhash.xxh3_128_intdigest(part)), part.decode(), low, high))
                at = end
        return dict(zip(names, map(list, zip(*rows)))) if rows else {c: [] for c in names}

    return map_batches(large.select("key", "pos", "g1", "g2", "words", "low", "high"), run, "p1 long, p2 long, skip int, key long, pos int, g1 long, g2 long, words string, low long, high long")


def suffix_array(nodes: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin at starts, in order, and the common prefix in words of each with the one before it (0 for the
    first). nodes holds a number for each word, and one of its own after each text; longest bounds the texts.

    Prefix doubling: ranks at depth 2d are those of pairs of ranks at depth d. The deepest ranks take in whole texts: by
    fewer words, equal windows could lie apart."""
    ranks, depth = [nodes], 1
    while depth < longest:
        now = ranks[-1]
        ahead = np.concatenate([now[depth:], np.full(depth, -1)]) + 1
        ranks.append(np.unique(now * (int(ahead.max()) + 1) + ahead, return_inverse=True)[1])
        depth *= 2
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        same = (a < len(nodes)) & (b < len(nodes))
        same[same] = ranks[level][a[same]] == ranks[level][b[same]]
        common += step * same
        a, b = a + step * same, b + step * same
    return order, np.concatenate([[0], common])


def tree_minima(texts: list[str], least: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment and each of its suffixes, the least doc_id of the segments that hold the same WINDOW words."""
    known: dict[str, int] = {}
    parts = [t.split(" ") for t in texts]
    sizes = np.array([len(p) for p in parts])
    words = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p), np.int64, int(sizes.sum()))
    nodes = np.insert(words, np.cumsum(sizes), len(known) + np.arange(len(parts)))  # each text ends in a sign of its own
    counts = sizes - window + 1
    firsts = np.cumsum(sizes + 1) - sizes - 1
    starts = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    order, common = suffix_array(nodes, starts, int(sizes.max()))
    node = np.cumsum(common < window) - 1  # topmost internal nodes of depth window or more, and leaves outside them
    owner = np.searchsorted(firsts, order, side="right") - 1
    low = np.minimum.reduceat(least[owner], np.flatnonzero(common < window))
    found = np.empty(len(order), np.int64)
    found[np.searchsorted(starts, order)] = low[node]
    return np.split(found, np.cumsum(counts)[:-1])


def minima_by_tree(distinct: DataFrame, window: int) -> DataFrame:
    """(key, g1, g2, words, low, high), partitioned and sorted by key, to (g1, g2, minima)."""
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("minima", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
            got = tree_minima(rows["words"].to_pylist(), low, window)
            useful = [i for i, m in enumerate(got) if high[i] > low[i] or (m < low[i]).any()]
            at = pa.array(useful, pa.int64())  # typed: a list without places, where nothing repeats, would be of type null
            return pa.RecordBatch.from_arrays([rows["g1"].take(at).combine_chunks(), rows["g2"].take(at).combine_chunks(), pa.array([got[i] for i in useful], type=pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= TASK_SEGMENTS:
                rows = pa.concat_tables(held)
                keys = rows["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield flush(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield flush(rows)

    return distinct.mapInArrow(run, "g1 long, g2 long, minima array<long>")


def tree_results(distinct: DataFrame, window: int) -> DataFrame:
    """(key, pos, g1, g2, words, low, high) to (g1, g2, skip, minima): for each segment, the least doc_ids of its suffixes from
    number `skip` on. Prefixes with too many segments are lengthened, again and again."""
    origin, results = None, []
    for most in (*RUNS, None):
        large = stored(distinct.groupBy("key").count().where(F.col("count") > GROUP_SEGMENTS).select("key"), "repeats-large")
        tasks = max(1, -(-distinct.count() // (4 * TASK_SEGMENTS)))
        # The last prefixes are as long as a window, so that no key is large there; if one were, a task would take it as it is.
        rest = distinct if most is None else distinct.join(large, "key", "left_anti")
        small = rest.select("key", "g1", "g2", "words", "low", "high")
        minima = minima_by_tree(small.repartition(tasks, "key").sortWithinPartitions("key"), window)
        if origin is None:
            results.append(minima.select("g1", "g2", F.lit(0).alias("skip"), "minima"))
        else:
            results.append(minima.join(origin, ["g1", "g2"]).select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), "skip", "minima"))
        if most is None or large.isEmpty():
            break
        pieces = stored(shorter(distinct.join(large, "key", "left_semi"), window, most), "repeats-pieces")
        came = pieces.select("p1", "p2", F.col("skip").alias("more"), "g1", "g2")
        if origin is None:
            origin = came.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("more").alias("skip"), "g1", "g2")
        else:
            whole = origin.select("s1", "s2", "skip", F.col("g1").alias("p1"), F.col("g2").alias("p2"))
            origin = whole.join(came, ["p1", "p2"]).select("s1", "s2", (F.col("skip") + F.col("more")).alias("skip"), "g1", "g2")
        distinct = stored(pieces.groupBy("key", "pos", "g1", "g2", "words").agg(F.min("low").alias("low"), F.max("high").alias("high")), "repeats-segments")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept, kept_sha256) of each row; kept, the words left, is null where all stay."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = stored(survey(docs, window, gram), "repeats-survey")
    runs = seen.select("doc_id", "text_key", F.explode("runs").alias("r")).select("doc_id", "text_key", "r.*")
    # Written first: a join with an aggregate of the same key would keep each anchor's runs in one task, however many.
    shared = stored(runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "repeats-anchors")
    wanted = runs.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("anchor", "first", "n", "at")).alias("runs"))
    key = map_batches(docs, lambda ids, texts: {"doc_id": ids, "text_key": list(map(text_key, texts)), "text": texts}, "doc_id long, text_key long, text string")
    held = stored(key.join(wanted, ["doc_id", "text_key"]), "repeats-texts")

    distinct = segments(held, window, True).groupBy("key", "pos", "g1", "g2", "words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    minima = tree_results(stored(distinct, "repeats-segments"), window)
    members = segments(held, window, False).select("doc_id", "text_key", "first", "g1", "g2")
    starts = members.join(minima, ["g1", "g2"]).select("doc_id", "text_key", F.filter(F.transform("minima", lambda m, i: F.when(m < F.col("doc_id"), F.col("first") + F.col("skip") + i)), lambda x: x.isNotNull()).alias("starts"))
    found = starts.where(F.size("starts") > 0).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def cut(ids: list, keys: list, texts: list, starts: list) -> dict:
        out: dict = {"doc_id": ids, "text_key": keys, "n_removed": [], "kept": [], "kept_sha256": []}
        for text, at in zip(texts, starts):
            words = split_words(text)
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array(at))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(kept).decode())
            out["kept_sha256"].append(words_digest(kept))
        return out

    texts = held.select("doc_id", "text_key", "text").join(found, ["doc_id", "text_key"])
    cuts = map_batches(texts, cut, "doc_id long, text_key long, n_removed long, kept string, kept_sha256 string").dropDuplicates(["doc_id", "text_key"])
    return seen.select("doc_id", "text_key", "n_words", "sha256").join(cuts, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept", F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    )
