"""License scan: what its plan does, and odd rows."""

import re

from pyspark.sql import functions as F

from palisade.llm import licenses

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \t\n", "...", "one", " one two ", "K İx ÅNGSTROM", "a\x00b\x7fc", "café-CAFÉ \U0001f600\U0001f600   x", "CC-BY-NC", " cc by nc cc by nc "]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def report(spark, rows):
    return licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string"))


def test_words_are_counted_by_the_split(spark):
    got = report(spark, list(enumerate(TEXTS)))
    assert "regexp_extract_all" not in plan(got)
    assert {r.doc_id: r.n_words for r in got.collect()} == {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))) for i, t in enumerate(TEXTS)}


def test_only_runs_of_templates_become_rows(spark):
    texts = [*TEXTS, "the license the software under the MIT license of the software", "all rights reserved all rights all rights reserved", "under the mit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {gram for gram, *_ in licenses.template_runs()}
    want = []
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        want += [(i, at, gram) for at in range(len(w) - 2) if (gram := " ".join(w[at : at + 3])) in known]
    assert sorted(map(tuple, licenses.cut_texts(docs).select("doc_id", F.inline("runs")).collect())) == want
    assert len(want) == 9


def test_texts_are_cut_once_and_the_runs_are_read_by_both_sides(spark):
    rows = [(None, None), (None, None), (None, "CC-BY-NC"), (1, "under the MIT license"), (1, "under the MIT license"), (1, "all rights reserved"), (2, "")]
    got = report(spark, rows)
    assert "split(" not in plan(got)
    assert all("license-texts" in f for f in got.inputFiles())
    found = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in got.collect()))
    assert found == [(0, 0, 0, ""), (0, 0, 0, ""), (0, 3, 1, "cc-by-nc"), (1, 3, 0, "all-rights"), (1, 4, 1, "mit"), (1, 4, 1, "mit"), (2, 0, 0, "")]


def test_runs_are_put_together_only_if_each_word_has_its_place(spark):
    words = spark.createDataFrame([(["of", "the", "conditions"],), (["of", "the", "software"],), (["of", "the"],), ([],)], "words array<string>")
    got = words.select(licenses.known_runs(F.col("words")).alias("runs"))
    assert plan(got).upper().count(" INSET ") == licenses.GRAM + 1
    assert [[r.gram for r in x.runs or []] for x in got.collect()] == [[], ["of the software"], [], []]
