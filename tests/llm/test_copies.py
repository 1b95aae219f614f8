"""Substring dedup and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import line_dedup, substring_dedup
from tests.llm.conftest import ROWS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_removal(rows, window=50):
    """(doc_id, n_words, n_removed, sha256 of what is kept) of rows with a doc_id."""
    first = {}
    texts = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - window + 1 if i is not None else 0):
            run = tuple(words[k : k + window])
            first[run] = min(i, first.get(run, i))
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def removed(frame):
    return order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(frame).collect()])


def planted(seed=3):
    """Documents that share passages of 40 to 120 words, cut at every place, and texts of one word over and over."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passages = [[word() for _ in range(rng.choice((40, 49, 50, 51, 60, 120)))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [word() for _ in range(rng.randint(0, 60))] + rng.choice(passages)
        rows.append((i, rng.choice((" ", "  ", "\n")).join(words)))
    return rows + [(70, "la " * 49), (71, "la " * 50), (72, "la " * 130), (73, "la " * 51 + "lo " + "la " * 60), (74, rows[5][1]), (75, rows[5][1])]


def test_repeats_in_planted_texts(spark):
    rows = planted()
    want = order(slow_removal(rows))
    assert sum(r[2] > 0 for r in want) > 30
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == want


@pytest.mark.parametrize("bound", [1, 3])
def test_prefixes_are_lengthened_until_groups_fit(spark, monkeypatch, bound):
    monkeypatch.setattr(substring_dedup, "GROUP_SEGMENTS", bound)
    rows = planted(4)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == order(slow_removal(rows))


@pytest.mark.parametrize("bound", [1, 4096])
def test_anchors_are_shared_but_no_window(spark, monkeypatch, bound):
    """Passages of 49 words in two documents each: their prefixes are shared, and no tree has a window that repeats."""
    monkeypatch.setattr(substring_dedup, "GROUP_SEGMENTS", bound)
    passages = [" ".join(f"p{k}w{i}" for i in range(49)) for k in range(3)]
    rows = [(i, " ".join(f"{side}{i}w{k}" for k in range(60)) + f" {passages[i // 2]} " + " ".join(f"{side}{i}v{k}" for k in range(60))) for i, side in enumerate("abcdef")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == [(i, 169, 0, hashlib.sha256(text.encode()).hexdigest()) for i, text in rows]


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randint(0, rng.choice((1, 3, 50))) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 8))]
        nodes, starts = [], []
        for i, t in enumerate(texts):
            starts += range(len(nodes), len(nodes) + len(t))
            nodes += [*t, 1000 + i]
        got, common = substring_dedup.suffix_array(np.array(nodes), np.array(starts), max(map(len, texts)))
        suffix = lambda i: nodes[i : next(k for k in range(i, len(nodes)) if nodes[k] >= 1000) + 1]
        assert [suffix(i) for i in got] == sorted(map(suffix, starts))
        for a, b, n in zip(got, got[1:], common[1:]):
            x, y = suffix(a), suffix(b)
            assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("words", [50, 52, 60, 92])
def test_equal_windows_meet_behind_equal_beginnings(words):
    """Texts that agree in 32 to 49 words and part after them, as in prefixes that were lengthened for a crowd."""
    rng = random.Random(words)
    for same in (31, 32, 33, 48, 49):
        head = [f"h{i}" for i in range(same)]
        tails = [[rng.choice("xyz") for _ in range(words - same)] for _ in range(3)]
        parts = [head + rng.choice(tails) for _ in range(12)]
        least, first = np.arange(12), {}
        for i, p in enumerate(parts):
            for k in range(words - 49):
                first.setdefault(tuple(p[k : k + 50]), i)
        got = substring_dedup.tree_minima([" ".join(p) for p in parts], least)
        assert [g.tolist() for g in got] == [[first[tuple(p[k : k + 50])] for k in range(words - 49)] for p in parts]


def test_repeats_in_tables(docs, sample):
    assert removed(docs) == order(slow_removal([(i, t) for i, t, *_ in sample]))


def test_repeats_in_edge_rows(edge, empty):
    assert removed(edge) == order(slow_removal([r[:2] for r in ROWS]))
    assert substring_dedup.drop_repeats(empty).count() == 0


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def slow_lines(rows, edits=2, least=20):
    """A row (doc_id, lines with a word, copies, near copies, removed line numbers) for each row."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    keys = {r.t: r.k for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) k").collect()}
    lines = lambda t: [(n, line) for n, line in enumerate((t or "").split("\n")) if WORDS.search(line)]
    places = {}
    for i, t in rows:
        for n, line in lines(t) if i is not None else ():
            here = (i, keys[t or ""], n)
            places[line] = min(here, places.get(line, here))
    some = sorted(places, key=len)
    near = set()
    for x, a in enumerate(some):
        for b in some[x + 1 :]:
            if len(b) - len(a) > edits:
                break
            if len(a) >= least and distance(a, b, edits) <= edits:
                near.add(max(a, b, key=places.get))
    out = []
    for i, t in rows:
        own = lines(t)
        copies = {n for n, line in own if i is not None and places[line] < (i, keys[t or ""], n)}
        close = {n for n, line in own if i is not None and line in near}
        out.append((i, len(own), len(copies), len(close - copies), ",".join(map(str, sorted(copies | close)))))
    return order(out)


def lined(seed=9, most=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(19, 45))) + "end" for _ in range(40)]

    def edit(line):
        for _ in range(rng.randint(0, most)):
            k = rng.randrange(len(line))
            line = rng.choice((line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "y" + line[k + 1 :]))
        return line

    return [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 12)))) for i in range(50)]


def crowded(seed):
    """Many lines that share two thirds of their letters: most lie beyond two edits of each other, some within, at every length."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
        rows.append((i % 100, f"the same beginning of every line {word} and its very same end" + "\nshort one" * (i % 3)))
    return rows


def report(spark, rows):
    return order([tuple(r) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()])


@pytest.mark.parametrize("rows", [lined(), lined(11, 6), [r[:2] for r in ROWS], [(1, None), (2, ""), (3, " \n\t"), (4, "\n")]])
def test_lines(spark, rows):
    assert report(spark, rows) == slow_lines(rows)


@pytest.mark.parametrize("block", [2, 64])
def test_crowded_segments_lose_no_line(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = crowded(10)
    got = report(spark, rows)
    assert got == slow_lines(rows) and sum(g[3] for g in got) > 20 and sum(g[1] > 0 and g[2] + g[3] == 0 for g in got) > 20


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    word = lambda n: "".join(rng.choice("aé\U0001f600z") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("ab", ""), ("abc", "abc")]
    for _ in range(400):
        a = word(rng.randint(0, 12))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = word(rng.randint(0, 1))
        pairs.append((a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", line_dedup.within(frame.a, frame.b, edits).alias("near")).collect()
    assert [(r.a, r.b, r.near) for r in got] == [(a, b, distance(a, b, edits) <= edits) for a, b in pairs]


def test_lines_of_tables(docs, sample):
    want = slow_lines([(i, t) for i, t, *_ in sample])
    assert order([tuple(r) for r in line_dedup.line_report(docs).collect()]) == want and any(w[2] or w[3] for w in want)


def test_lines_keep_columns(edge, empty):
    left = line_dedup.drop_lines(edge)
    assert left.columns == edge.columns and left.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert Counter(texts[9].split("\n"))["same line of words here"] == 1
    assert line_dedup.line_report(empty).count() == 0


def test_dropped_lines_are_the_row_s_own(spark):
    rows = [(7, "an entirely different opening, found nowhere else"), (7, "a line that stands in both of the documents here"), (3, "a line that stands in both of the documents here"), (None, "a line that stands in both of the documents here")]
    got = {(r.doc_id, r.text) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, "an entirely different opening, found nowhere else"), (7, ""), (3, rows[2][1]), (None, rows[3][1])}


ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "han": "".join(chr(0x4E00 + i) for i in range(2000)), "emoji": "".join(chr(0x1F300 + i) for i in range(200))}


@pytest.mark.parametrize("alphabet", [*ALPHABETS, "anagrams"])
def test_crowds_of_any_alphabet_stay_small(spark, monkeypatch, alphabet):
    """Many lines of one segment, none near another: what is verified grows with the lines, not with their pairs."""
    rng, n = random.Random(1), 600
    if alphabet == "anagrams":
        tail = lambda: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", 36))
    else:
        tail = lambda: "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(36))
    rows = [(i, "the segment that all of" + tail()) for i in range(n)]
    counted, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts, edits: counted.append(pairs.distinct().count()) or verified(pairs, texts, edits))
    got = report(spark, rows)
    assert sum(g[3] for g in got) == 0
    assert counted[-1] < n and sum(counted) < 3 * n


@pytest.mark.parametrize("alphabet", ["cyrillic", "han", "emoji"])
def test_near_lines_of_any_alphabet(spark, alphabet):
    """Crowds of over BLOCK lines with near lines in them, edits across alphabets included."""
    rng = random.Random(2)
    letters = ALPHABETS[alphabet][:12] + "aé"
    rows = []
    for i in range(150):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(3, 5)))
        rows.append((i, f"{letters}{letters} {word} {letters}{letters}"))
    got = report(spark, rows)
    assert got == slow_lines(rows) and sum(g[3] for g in got) > 10


def test_neighbour_bits_turn_with_edits(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(500):
        a = "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(1, 30)))
        k = rng.randrange(len(a))
        b = rng.choice((a[:k] + a[k + 1 :], a[:k] + "z" + a[k:], a[:k] + "é" + a[k + 1 :]))
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a string, b string")
    differ = lambda f: F.bit_count(f(F.col("a")).bitwiseXOR(f(F.col("b"))))
    got = frame.where("a <> '' AND b <> ''").select(differ(line_dedup.parities).alias("letters"), differ(line_dedup.neighbours).alias("pairs")).agg(F.max("letters"), F.max("pairs")).first()
    assert got[0] <= 2 and got[1] <= 4
