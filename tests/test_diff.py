"""The diff of two scans: findings that a document had before planting are not new."""

from palisade import queries as Q
from palisade.operators import findings, threats
from pyspark.sql import Row


def test_earlier_findings_are_not_new(spark, tmp_path):
    rows = [(0, "autostart stands here", "en", "src0", 21), (61, "nothing stands here", "en", "src0", 19), (27, "autostart stands here", "en", "src0", 21)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    planted = {r.path for r in Q.static_findings(spark, str(tmp_path)).where("category LIKE 'SD-08%'").collect()}
    assert planted == {"en/doc_0.md", "en/doc_27.md"}
    got = Q.diff_findings(spark, str(tmp_path)).collect()
    assert {r.path for r in got} == {"en/doc_0.md", "en/doc_61.md"} and {r.change for r in got} == {"new"}
    assert not [r for r in got if r.category.startswith("SD-08")]


def plans(df):
    """How often a job of df would make what mapInArrow makes."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_a_diff_makes_each_scan_once(spark):
    schema = "bundle_id string, path string, line int, category string, severity string"
    a, b = ("b", "p", 1, "c", "LOW"), ("b", "p", None, "c", "LOW")
    scans = [spark.createDataFrame(rows, schema).mapInArrow(lambda batches: batches, schema) for rows in ([a, b, b, ("b", None, 2, "c", "LOW")], [b, ("b", "p", 1, "c", "HIGH"), ("b", "p", 1, "c", "HIGH")])]
    got = findings.diff(*scans)
    assert sorted(map(repr, got.collect())) == sorted(repr(Row(**dict(zip(got.columns, r)))) for r in [(*a, "gone"), ("b", None, 2, "c", "LOW", "gone"), ("b", "p", 1, "c", "HIGH", "new")])
    assert plans(got) == 2


def test_a_merge_makes_each_table_once(spark):
    schema = "hash string, category string, severity string, description string"
    old, new = [("a", "c", "LOW", "1"), ("a", "c", "LOW", "2"), ("b", "c", "LOW", "3"), (None, "c", "LOW", "4")], [("b", "d", "HIGH", "5"), ("e", "d", "HIGH", "6"), (None, "d", "HIGH", "7")]
    got = threats.merged(*[spark.createDataFrame(rows, schema).mapInArrow(lambda batches: batches, schema) for rows in (old, new)])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*old[:2], old[3], *new], key=repr)
    assert plans(got) == 2
