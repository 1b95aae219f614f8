"""Token store, source mixing, decontamination and the pipeline against plain Python and DuckDB."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palisade.llm import decontaminate, mixing, quality, queries, token_store
from tests.llm.conftest import DOCS, ROWS, SF
from tests.llm.test_similar import slow_groups

PATH = public_tokenizers.path("word_bpe_49k.json")

# Token store


def plain_report(rows):
    """Ids by the library over whole texts, in the store's order (ties in doc_id by their frames are left to the store)."""
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]


def check_report(frame, rows):
    got = token_store.token_report(frame, PATH).collect()
    want = plain_report(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_tokens_of_tables(docs, sample):
    check_report(docs, [(i, t) for i, t, *_ in sample])


def test_tokens_of_edge_rows(edge, empty):
    check_report(edge, [r[:2] for r in ROWS])
    assert token_store.token_report(empty, PATH).count() == 0


def test_encoder_agrees_with_the_library_on_odd_texts():
    tokenizer, enc = Tokenizer.from_file(PATH), token_store.Encoder(PATH)
    rng = random.Random(11)
    signs = list("abcXYZ019 '\"<|>#_-.,\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0éÉßµªº²³¹¼¾×÷àþÿŸ") + ["'s", "'LL", "don't", "K", "İ", "ſ", "é", "​", "　", "﻿", "漢字", "😀", "<|end", " ", "٣", "ﬁ"]
    for n in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert enc.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_one_document_is_read_alone(spark, docs, sample, monkeypatch):
    from palisade.session import shared_path

    monkeypatch.setattr(token_store, "SHARD_BYTES", 20_000)
    path = shared_path(spark, "store")
    token_store.write_tokens(docs, path, PATH)
    want = plain_report([(i, t) for i, t, *_ in sample[::40]])
    assert spark.read.parquet(f"{path}/shards").count() > 3
    for i, ids in want:
        assert token_store.read_document(spark, path, i) == [ids.tolist()]
    assert token_store.read_document(spark, path, 10**9) == []
    with pytest.raises(ValueError, match="dictionary"):
        token_store.unpacker(bytes(spark.read.parquet(f"{path}/shards").first().blob), "00" * 32, b"")


# Mixing


def test_mixing_against_sql(spark):
    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
    got = sorted(tuple(r) for r in queries.op6_mixing(spark, SF).select(*columns).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall()) and {r[-1] for r in got} >= {0, 1}


def test_mixing_takes_rows_one_by_one(spark):
    """Rows that share a doc_id, and equal rows, are each taken as often as mix() says of them."""
    rows = [(i % 7 if i % 3 else None, f"text {'word ' * (i % 11)}", "en", f"src{i % 3}", i) for i in range(300)] + [(1, "twice the same", "en", "src1", 5)] * 9
    frame = spark.createDataFrame(rows, DOCS)
    for percent in (30, 90, 140):
        got = mixing.mixed(frame, percent=percent)
        counts = mixing.mix(frame, percent=percent).groupBy("source", "n_tokens").agg(F.sum("copies").alias("n")).where("n > 0")
        words = F.regexp_count("text", F.lit(mixing.WORDS)).cast("long")
        assert {tuple(r) for r in got.groupBy("source", words.alias("n_tokens")).count().collect()} == {tuple(r) for r in counts.collect()}
        assert got.groupBy(*DOCS.names).count().where("count > 18").count() == 0


def slow_deal(budget, children):
    """Shares of a budget by weight; children: {name: (cap, weight)}."""
    share, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap * total <= w * budget]
        if not full:
            return share | {n: w * budget // total for n, (_, w) in open_.items()}
        least = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        share[least] = open_.pop(least)[0]
        budget -= share[least]
    return share


def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", 10, 1, 100), ("web", "de", 500, 1, 100), ("books", "en", 30, 3, 50), ("books", "fr", 30, 1, 50), ("books", "xx", 0, 1, 50)]
    frame = spark.createDataFrame(rows, "p string, name string, cap long, weight long, budget long")
    got = {(r.p, r.name): r.share for r in mixing.deal(frame, ["p"]).collect()}
    for p, budget in (("web", 100), ("books", 50)):
        want = slow_deal(budget, {n: (c, w) for q, n, c, w, _ in rows if q == p})
        assert {n: s for (q, n), s in got.items() if q == p} == want
    assert got["web", "de"] == 90 and got["books", "en"] == 30 and got["books", "fr"] == 20


def test_mixing_edge_rows(edge, empty):
    got = mixing.mix(edge)
    assert got.count() == len(ROWS) and got.where("copies IS NULL OR copies < 0").count() == 0
    chosen = mixing.mixed(edge)
    assert chosen.columns == edge.columns and chosen.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# Decontamination


def plain_matches(index, text):
    """Every passage against every item, without index or bound."""
    words, out = decontaminate.words_of(text), {}
    width, step = 2 * index.longest, index.longest
    for lo in range(0, len(words), step):
        passage = words[lo : lo + width]
        have = {index.terms[w] for w in passage if w in index.terms}
        for d in range(len(index.items)):
            score = sum(w for t in have for item, w in zip(*index.lists[t]) if item == d)
            if score >= decontaminate.MIN_SCORE - 1e-9:
                q, a = (decontaminate.share(h, passage) for h in index.halves[d])
                if q >= decontaminate.OVERLAP and a >= decontaminate.OVERLAP:
                    out[d] = max(out.get(d, 0), score)
    return {index.items[d][0]: round(s, 9) for d, s in out.items()}


def quiz(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(("the", "of", "and")) if rng.random() < 0.4 else f"w{rng.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25))) + "? " + " ".join(word() for _ in range(rng.randint(1, 8))) + ".") for i in range(40)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 200))]
        if i % 2:
            leak = rng.choice(items)[1].split()
            if i % 4 == 1:
                del leak[rng.randrange(len(leak))]
            at = rng.randint(0, len(words))
            words[at:at] = leak if i % 6 else leak[: len(leak) // 2]
        rows.append((i, " ".join(words)))
    return items, rows


def test_search_finds_what_exhaustive_scoring_finds():
    items, rows = quiz()
    index = decontaminate.Index(items)
    found = [({i: round(s, 9) for i, s, *_ in index.matches(t)}, plain_matches(index, t)) for _, t in rows]
    assert all(a == b for a, b in found) and sum(bool(a) for a, _ in found) > 15
    rng = random.Random(1)
    for threshold in (0.1, 0.3, 0.6):  # block-max WAND by itself
        for _ in range(100):
            terms = sorted(rng.sample(range(len(index.terms)), 40))
            scores = {}
            for t in terms:
                for d, w in zip(*index.lists[t]):
                    scores[d] = scores.get(d, 0) + w
            assert {d: round(s, 9) for d, s in index.search(terms, threshold)} == {d: round(s, 9) for d, s in scores.items() if s >= threshold - 1e-9}


def test_decontamination_of_frames(spark, edge, empty, monkeypatch):
    items, rows = quiz(8)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    index = decontaminate.Index(items)
    assert hits == {(i, m) for i, t in rows for m in plain_matches(index, t)} and hits
    left = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in hits}
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(ROWS)
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_shards_and_passes_change_no_score(spark, monkeypatch):
    items, rows = quiz(9)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.Index(items)
    want = {(i, m, s) for i, t in rows for m, s in plain_matches(index, t).items()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 6)
    for passes in (1, 3):
        monkeypatch.setattr(decontaminate, "PASS_SHARDS", passes)
        assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
    monkeypatch.setattr(decontaminate, "TABLE", 50)
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench).collect()} == want and want


def test_a_long_item_widens_no_other_passage(spark, monkeypatch):
    """Items of several classes of lengths: each is found as an index of its class alone finds it."""
    monkeypatch.setattr(decontaminate, "CLASS_WORDS", 12)
    items, rows = quiz(11)
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 300)}" for _ in range(900)) + "? And that is all."
    items.append((77, long))
    rows.append((500, f"before it {long} behind it"))
    stats = decontaminate.stats_of(items)
    parts = decontaminate.indexes(items, stats)
    assert len(parts) > 2 and sorted(p.longest for p in parts) == sorted(stats.longest.values())
    want = {(i, m, s) for i, t in rows for p in parts for m, s in plain_matches(p, t).items()}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert (500, 77) in {w[:2] for w in want}


def test_every_passage_of_tables_against_exhaustive_scoring(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontaminate.Index([(r.item_id, r.text) for r in bench.collect()])
    want = {(r.doc_id, i) for r in docs.collect() for i in plain_matches(index, r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want


def test_planted_items_are_found(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    whole = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if r.text in t}
    assert whole <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


# Pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage's decisions take effect on what its predecessor kept."""
    now = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (
        lambda before, after: {r.doc_id for r in quality.quality_report(before).where("kept").collect()},
        lambda before, after: set(slow_groups([(r.doc_id, r.text) for r in before.collect()]).values()),
        lambda before, after: {r.doc_id for r in before.collect()} - {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()},
        lambda before, after: {r.doc_id for r in mixing.mix(before).where("copies > 0").collect()},
        lambda before, after: {r.doc_id for r in before.collect()},
    )):
        after = stage(spark, now, SF)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} == check(now, after)
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
        if name == "tokens":
            assert after.count() == now.count()
            want = {i: zlib.crc32(x.tobytes()) for i, x in plain_report([(r.doc_id, r.text) for r in now.dropDuplicates(["doc_id"]).collect()])}
            assert {r.doc_id: r.ids_crc32 for r in after.collect()} == want
        now = after


def test_pipeline_on_edge_rows_and_an_empty_table(spark, edge, empty, tmp_path):
    for frame in (edge.select(*DOCS.names), empty):
        frame.write.parquet(f"{tmp_path}/sf/documents.parquet", mode="overwrite")
        spark.createDataFrame([(1, "What is it? A test.")], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet", mode="overwrite")
        got = corpus_pipeline.run(spark, f"{tmp_path}/sf")
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        ends = got.agg(F.coalesce(F.max(F.col("start") + F.col("n_tokens")), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        assert ends[0] == ends[1]
