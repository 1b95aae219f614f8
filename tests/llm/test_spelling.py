"""Spelling variants against edit distances of all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import spelling
from tests.llm.conftest import ROWS

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def slow_words(rows, shortest=7, least=2):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def slow_variants(counts):
    lengths = {}
    for w in counts:
        lengths.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in lengths.get(len(w) + k, []) if one_apart(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants(frame, **settings):
    return sorted(tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(frame, **settings).collect())


def test_all_documents_of_the_smallest_tables(spark, docs, sample):
    want = slow_variants(slow_words([(i, t) for i, t, _, _ in sample]))
    assert variants(docs) == want
    assert sum(w[1] is not None for w in want) > 5


def edits(seed, alphabet, n):
    """Words of few letters, with many pairs one edit apart and long runs of a letter."""
    rng, words = random.Random(seed), []
    while len(words) < n:
        w = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(4, 9)))
        for _ in range(rng.randint(1, 6)):
            words.append(w)
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(alphabet) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
    return [w for w in words if len(w) >= 7]


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "abcdefgÿà"), (3, "xyzé")])
def test_few_letters(spark, monkeypatch, seed, alphabet):
    """Crowded groups, dealt again by halves of their spans until they have few rows or one place."""
    monkeypatch.setattr(spelling, "MOST_ROWS", 8)
    monkeypatch.setattr(spelling, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(spelling, "MOST_QUERIES", 300)
    rng = random.Random(seed)
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in edits(seed, alphabet, 700)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.neighbours(words).collect()}
    want = slow_variants(counts)
    assert {w: x[0] for w, x in got.items()} == {w[0]: w[4] for w in want if w[4]}
    assert {w: x[1] for w, x in got.items() if x[2] >= 10 * counts[w]} == {w[0]: w[1] for w in want if w[1]}
    most = spelling.groups(words).groupBy("g", "a", "b").count().where("b - a > 1").agg(F.max("count")).first()[0]
    assert most <= 8


def test_one_beginning_for_all(spark, monkeypatch):
    """Words with one beginning and one end: every group of the first halves holds all of them."""
    monkeypatch.setattr(spelling, "MOST_ROWS", 16)
    rng = random.Random(5)
    counts = {"begin" + "".join(rng.choice("abcd") for _ in range(4)) + "finis": rng.choice([2, 50]) for _ in range(300)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.word: r.n_near for r in spelling.neighbours(words).collect()} == {w[0]: w[4] for w in slow_variants(counts) if w[4]}


def test_edge_rows(spark, edge, empty):
    long = "Z" * 30_000
    more = [(100, f"{long} {long} {long[:-1]} {long[:-1]}"), (101, "chapter " * 50 + "chapeter chapeter chaptre chapte chapte Chapters CHAPTERS"), (None, "chapter chapter İstanbul ÉCLAIRS éclairs ×÷×÷×÷× ×÷×÷×÷×")]
    rows = [(r[0], r[1]) for r in ROWS] + more
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = frame.select("*", *[F.lit(1).alias(c) for c in ("word", "run", "n", "class", "a", "b", "g", "doc", "bucket", "root", "form")])
    assert variants(clash) == variants(frame) == slow_variants(slow_words(rows))
    assert variants(edge) == slow_variants(slow_words([(r[0], r[1]) for r in ROWS]))
    assert variants(empty) == []
    assert variants(frame, shortest=1, least=1) == slow_variants(slow_words(rows, 1, 1))


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        low, high, first, last = (rng.integers(0, n + 1, 200) for _ in range(4))
        query, value = tree.report(low, high, first, last)
        want = sorted((q, v) for q in range(200) for v in values[low[q] : high[q]].tolist() if first[q] <= v < last[q])
        assert sorted(zip(query.tolist(), value.tolist())) == want


def test_a_row_for_each_word_leaves_a_task():
    """A crowd of n near words gives n rows, not n squared."""
    words = [f"abcde{chr(97 + i)}xyz" for i in range(26)]
    table = pa.table({"word": words, "n": [2] * 26, "class": [9] * 26, "a": [4] * 26, "b": [9] * 26})
    got = spelling.evidence(table)
    assert got.num_rows == 26 and set(got.column("n_near").to_pylist()) == {25}
