import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Names that operators use inside; as columns of the input they must change nothing.
CLASHING = ["h", "key", "words", "fp", "rep", "component_id", "kept", "quality", "part", "shard", "n_tokens", "copies", "hash", "anchor", "place", "line", "line_no", "items", "item_id", "spans", "base", "label", "score"]
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

SENTENCE = "the quick brown fox jumps over the lazy dog and runs along the river bank until the sun goes down behind the hills while nobody in the small village looks up from the long table where bread and cheese are laid out for all the guests who came from far away to hear the music of the old band"
#: (doc_id, text, lang, source, n_chars): nulls in every column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, SENTENCE, "en", "src0", len(SENTENCE)),
    (2, SENTENCE + " tonight", "en", "src0", None),
    (3, None, "en", "src1", 0),
    (4, "", None, None, 0),
    (5, " \t\n\x0b ", "xx", "src9", 5),
    (6, "Kelvin K and   nbsp   em \x1c fs \x1d gs, café CAFÉ \U0001f600 emoji", "fr", "src12", 1),
    (6, "Kelvin K and   nbsp   em \x1c fs \x1d gs, café CAFÉ \U0001f600 emoji", "fr", "src12", 1),
    (7, "one two three", "en", "src0", 13),
    (7, "a second text with the same number", "en", "src0", 13),
    (None, SENTENCE, "en", "src0", 9),
    (None, None, None, None, None),
    (8, " ".join(f"word{i % 9973}" for i in range(60_000)), "de", "src3", 1),
    (9, "same line of words here\n" * 40, "es", "src19", 1),
    (10, "x" * 100_000, "en", "src0", 1),
    (11, "mail a.b+c@d-e.example.org, 10.0.0.1 and 300.1.1.1, 4111 1111 1111 1111, +44 (20) 7946-0958; password: hunter22x", "en", "src4", 1),
    (12, "Released under the MIT License. Under the MIT license; licensed under the Apache License, Version 2.0; CC-BY-NC 4.0", "en", "src5", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with further columns of clashing names."""
    return spark.createDataFrame(ROWS, DOCS).select("*", *[F.lit("clash").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sample(docs):
    """All documents of the smallest tables, as Python rows."""
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
