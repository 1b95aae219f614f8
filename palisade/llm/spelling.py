"""Spelling variant grouping: words one edit apart, by two-dimensional range reporting in wavelet trees.

If two words differ by one replaced code point, they have one length; if by an inserted one, the longer has one more. So
each word stands in two classes: in the class of its own length as a target and as a probe for replacements, and in the class of
the next length as a probe for insertions. In a class, the place of the edit lies in one of two spans, and everything outside
the span is equal: a group is a class, a span and what stands outside it. A group with many rows is dealt again by halves of its
span, so that no group is large whatever many words begin with; with a span of one place a group holds no more rows than
the alphabet has letters.

A task holds a bounded number of rows of whole groups. Their targets stand in forward order (by group and by the span's
letters) and in reverse order (by group and by its letters from the end); the wavelet tree holds the reverse rank of each
target in forward order. For each probe and each edit place, the letters before it are an interval of the forward order,
those behind it one of the reverse order, and the tree reports the targets in both: exactly the words with that one
edit. A replacement has one place; an inserted letter counts at the first place of its run only, so each pair is found
once. What leaves a task is one row for each word and span, not the pairs.

Defined results: null texts have no words, a null doc_id is written as an empty string, repeated rows count each;
words of any length take part; ties in n go to the smaller word in code-point order; an empty table, or one without
words that qualify, gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import stored

LETTERS = "[A-Za-zÀ-ÿ]"
#: Rows above which a group is dealt again; rows and code points of spans that a task holds.
MOST_ROWS, ROWS_PER_TASK, LETTERS_PER_TASK = 4096, 40_000, 1 << 21
#: Pairs of interval queries and tree nodes that are held at a time.
MOST_QUERIES = 1 << 20
#: The same by a table of checksums and words with a hole at each place, for the registered query's parameters.
ORACLE_SQL = r"""
WITH RECURSIVE crc_bytes AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY ALL
), coded AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
), summed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)]))) AS crc
  FROM coded, crc_bytes
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN crc % 31 = 0 THEN left(run, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), holes AS (
  SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS replaced, left(word, i) || substr(word, i + 2) AS dropped FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT w.word, h.word, h.n FROM words w JOIN holes h ON h.dropped = w.word
  UNION SELECT h.word, w.word, w.n FROM words w JOIN holes h ON h.dropped = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), paths AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN formed f ON f.word = p.next
)
SELECT f.word, f.form, p.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN paths p ON p.word = f.word AND p.next IS NULL
"""


# ---- words ----


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(docs: DataFrame, shortest: int, one_in: int) -> DataFrame:
    """(word): a row for each run of letters of at least `shortest`; one in `one_in` loses a letter, chosen by a checksum of doc_id and run."""
    runs = F.expr(f"regexp_extract_all(text, '{LETTERS}{{{shortest},}}', 0)")  # shorter runs can't become long enough
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.transform(runs, lower_ascii)).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """(word, n): the distinct words of at least `shortest` code points that occur `least` times or more."""
    words = misspelt(docs.select("doc_id", "text"), shortest, one_in).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- wavelet tree ----


class WaveletTree:
    """Bit rows of a permutation, most significant bit first; zeros stand before ones in the next row."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # of each level, the zeros before each place
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [first, last) that stand at places in [low, high), for many queries at once."""
        query, base = np.arange(len(low)), np.zeros(len(low), np.int64)
        keep = (low < high) & (first < last)
        query, low, high, base = query[keep], low[keep], high[keep], base[keep]
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l0, h0, all_zeros, half = zeros[low], zeros[high], zeros[-1], 1 << level
            parts = []
            for lo, hi, start in ((l0, h0, base), (all_zeros + low - l0, all_zeros + high - h0, base + half)):
                ok = (lo < hi) & (start < last[query]) & (start + half > first[query])
                parts.append((query[ok], lo[ok], hi[ok], start[ok]))
            query, low, high, base = (np.concatenate(x) for x in zip(*parts))
        return query, base


# ---- groups ----


def runs_of(shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 places of the runs of rows that share `length` letters; shared: with the row before, -1 in a new group."""
    starts = np.flatnonzero(shared < length)
    number = np.cumsum(shared < length) - 1
    return starts[number], np.append(starts[1:], len(shared))[number]


def shared_letters(group: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Of sorted rows, how many leading letters a row shares with the row before; -1 in a new group."""
    same = letters[1:] == letters[:-1]
    count = np.where(same.all(1), letters.shape[1], np.argmin(same, axis=1)) if letters.shape[1] else np.zeros(len(letters) - 1, np.int64)
    return np.concatenate([[-1], np.where(group[1:] == group[:-1], count, -1)])


def letters_of(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1))[:, :width]


def one_edit(words: list[str], classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (probe, target) that differ by one code point in the span [a, b) of the target, whose length is the class."""
    long = np.fromiter(map(len, words), np.int64, len(words)) == classes
    outside = [(c, x, y, w[:x], w[y - (not t) :]) for w, c, x, y, t in zip(words, classes.tolist(), a.tolist(), b.tolist(), long.tolist())]
    numbers: dict[tuple, int] = {}
    group = np.fromiter((numbers.setdefault(k, len(numbers)) for k in outside), np.int64, len(words))
    size = b - a - ~long  # letters of the row in the span
    width = int((b - a).max(initial=0))
    middle = [w[x : x + s] for w, x, s in zip(words, a.tolist(), size.tolist())]
    ahead, back = letters_of(middle, width), letters_of([m[::-1] for m in middle], width)

    def ranks(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((*letters.T[::-1], group))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return order, place, shared_letters(group[order], letters[order]), np.concatenate([[0], np.cumsum(long[order])])

    (order, place, shared, targets), (_, back_place, back_shared, back_targets) = ranks(ahead), ranks(back)
    rows_forward = order[long[order]]  # the target of each forward rank
    backward = back_targets[back_place[rows_forward]]
    tree = WaveletTree(backward)
    of_backward = np.empty(len(backward), np.int64)
    of_backward[backward] = rows_forward
    before = np.array([ord(w[x - 1]) if x else 0 for w, x in zip(words, a.tolist())], np.int64)
    probes, found, held, queries = [], [], 0, []

    def flush() -> None:
        probe, at, low, high, first, last = (np.concatenate(x) for x in zip(*queries))
        query, value = tree.report(low, high, first, last)
        p, t, i = probe[query], of_backward[value], at[query]
        letter = ahead[t, i].astype(np.int64)
        previous = np.where(i > 0, ahead[t, np.maximum(i - 1, 0)], before[t])
        ok = np.where(long[p], p != t, letter != previous)  # not itself; an inserted letter at the first place of its run
        probes.append(p[ok])
        found.append(t[ok])

    reach = b - a
    for i in range(width):
        live = np.flatnonzero(i < reach)
        start, end = runs_of(shared, i)
        low, high = targets[start[place[live]]], targets[end[place[live]]]
        behind = size[live] - i - long[live]  # letters of the row behind the edit
        first, last = np.empty(len(live), np.int64), np.empty(len(live), np.int64)
        for length in np.unique(behind):
            some = behind == length
            start, end = runs_of(back_shared, length)
            at = back_place[live[some]]
            first[some], last[some] = back_targets[start[at]], back_targets[end[at]]
        least = np.where(long[live], 1, 0)  # a target always finds itself
        keep = (high - low > least) & (last - first > least)
        queries.append((live[keep], np.full(int(keep.sum()), i), low[keep], high[keep], first[keep], last[keep]))
        held += int(keep.sum())
        if held > MOST_QUERIES:
            flush()
            held, queries = 0, []
    if queries:
        flush()
    return np.concatenate(probes or [np.empty(0, np.int64)]), np.concatenate(found or [np.empty(0, np.int64)])


def evidence(table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best): what the rows (word, n, class, a, b) of whole groups say of each word."""
    columns = {c: table.column(c).to_numpy() for c in ("n", "class", "a", "b")}
    words, out = table.column("word").to_pylist(), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # Spans of like width at a time: a row of letters is then at most twice as wide as it needs to be.
    scale = np.frexp((columns["b"] - columns["a"]).astype(float))[1]
    for size in np.unique(scale):
        rows = np.flatnonzero(scale == size)
        probe, target = one_edit([words[r] for r in rows], columns["class"][rows], columns["a"][rows], columns["b"][rows])
        probe, target = rows[probe], rows[target]
        lengthened = columns["class"][probe] != np.fromiter((len(words[r]) for r in probe), np.int64, len(probe))
        out += [(probe, target), (target[lengthened], probe[lengthened])]  # replacements are found from both sides
    row, near = (np.concatenate(x) for x in zip(*out))
    by_word = np.argsort(np.array(words, dtype=object), kind="stable")  # code-point order
    rank = np.empty(len(words), np.int64)
    rank[by_word] = np.arange(len(words))
    order = np.lexsort((rank[near], -columns["n"][near], row))
    row, near = row[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(row)))
    best = near[first]
    return pa.table({"word": pa.array([words[r] for r in row[first]], pa.string()), "n_near": pa.array(counts, pa.int64()), "best_n": pa.array(columns["n"][best], pa.int64()), "best": pa.array([words[r] for r in best], pa.string())})


def key(word: Column, cls: Column, a: Column, b: Column) -> Column:
    """The group's hash: class, span and what stands outside the span."""
    behind = F.when(F.length(word) == cls, b).otherwise(b - 1)
    return F.xxhash64(cls, a, b, F.substring(word, F.lit(1), a), F.substring(word, behind + 1, F.length(word)))


def halves(a: Column, b: Column) -> Column:
    middle = ((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def dealt(rows: DataFrame, spans: Column) -> DataFrame:
    """rows (word, n, class) once for each of their spans, with the group's hash g."""
    out = rows.select("word", "n", "class", F.explode(spans).alias("span")).select("word", "n", "class", "span.a", "span.b").where("b > a")
    return out.withColumn("g", key(F.col("word"), F.col("class"), F.col("a"), F.col("b")))


def groups(words: DataFrame) -> DataFrame:
    """(word, n, class, a, b, g): no group g has more than MOST_ROWS rows, unless its span is one place."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("class"))
    rows, done = stored(dealt(sized, halves(F.lit(0), F.col("class"))), "spelling-groups"), None
    while True:
        wide = rows.where(F.col("b") - F.col("a") > 1)
        large = stored(wide.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > MOST_ROWS).select("g"), "spelling-large")
        ready = large.isEmpty()
        small = rows if ready else rows.join(large, "g", "left_anti")
        done = small if done is None else done.unionByName(small)
        if ready:
            return done
        rows = stored(dealt(wide.join(large, "g", "left_semi"), halves(F.col("a"), F.col("b"))), "spelling-groups")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), all distinct, that are one edit from another."""
    rows = groups(words)
    total = rows.agg(F.count("*"), F.sum(F.col("b") - F.col("a"))).first()
    tasks = max(1, -(-total[0] // ROWS_PER_TASK), -(-(total[1] or 0) // LETTERS_PER_TASK))
    cores = words.sparkSession.sparkContext.defaultParallelism
    tasks = max(tasks, 2 * cores)
    bucket = F.pmod(F.xxhash64("g"), F.lit(tasks))
    said = rows.select("word", *[F.col(c).cast("long").alias(c) for c in ("n", "class", "a", "b")], bucket.alias("bucket"))
    said = said.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: evidence(t), "word string, n_near long, best_n long, best string")
    best = said.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("least"))
    return best.select("word", "n_near", (-F.col("least.minus")).alias("best_n"), F.col("least.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead in the end. n grows tenfold with each step, so paths end soon."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        step = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = stored(paths.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-paths")
        if paths.where("moved").isEmpty():
            return paths.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): see the module's head."""
    words = stored(word_counts(docs, shortest, least, one_in), "spelling-words")
    near = neighbours(words)
    known = words.join(near, "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    known = stored(known, "spelling-known")
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
