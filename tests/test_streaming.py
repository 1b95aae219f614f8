"""Bundles as a stream against the stored threat table."""

import pytest

from palisade.operators.threat_store import ThreatStore
from palisade.streaming import watch

SCHEMA = "bundle_id string, path string, text string, content binary"


def files(spark, *rows):
    return spark.createDataFrame([(b, p, t, t.encode()) for b, p, t in rows], SCHEMA)


def results(spark, out):
    rows = spark.read.parquet(f"{out}/results")
    return sorted((r.batch, r.bundle_id, r.n_findings, r.risk_score, r.risk_level, r.scan_id) for r in rows.collect())


FIRST = [("bad", "a.md", "call os.system( here"), ("bad", "b.md", "admin"), ("odd", "a.md", "an agent that can impersonate"), ("good", "a.md", "nothing")]
SECOND = [("new-bad", "x.md", "call os.system( here"), ("new-bad", "y.md", "admin"), ("other", "a.md", "pickle.load( it"), ("good", "a.md", "nothing")]


def test_second_batch_is_answered(spark, tmp_path):
    store, out, drop, marks = ThreatStore(spark, f"{tmp_path}/t", 4), f"{tmp_path}/out", f"{tmp_path}/drop", f"{tmp_path}/marks"
    for rows in (FIRST, SECOND):
        files(spark, *rows).coalesce(1).write.mode("append").parquet(drop)
        watch.finished(watch.scan_bundles(spark.readStream.schema(SCHEMA).parquet(drop), store, out, marks))
    got = {(b, i): (n, level) for b, i, n, _, level, _ in results(spark, out)}
    assert got[0, "bad"] == (1, "DANGEROUS") and got[0, "odd"] == (1, "CAUTION") and got[0, "good"] == (0, "SAFE")
    assert got[1, "new-bad"] == (1, "DANGEROUS") and got[1, "good"] == (0, "SAFE") and got[1, "other"] == (1, "DANGEROUS")
    engines = {(r.batch, r.bundle_id): r.engine for r in spark.read.parquet(f"{out}/findings").collect()}
    assert engines == {(0, "bad"): "yara", (0, "odd"): "yara", (1, "new-bad"): "threat_db", (1, "other"): "yara"}
    assert store.read().count() == 3 and store.version().applied == {"scan": [1, 1]}


@pytest.mark.parametrize("dies", ["before the table changes", "after it"])
def test_batch_run_again(spark, tmp_path, monkeypatch, dies):
    """A batch that dies and is run again gives what it would have given, and the table holds its threats once."""
    store, out = ThreatStore(spark, f"{tmp_path}/t", 4), f"{tmp_path}/out"
    args = (store.root, out, "s", store.n)
    if dies.startswith("before"):
        with monkeypatch.context() as m:
            m.setattr(ThreatStore, "upsert", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                watch.scan_batch(files(spark, *FIRST), 0, *args)
        assert store.version().number == 0
    else:
        watch.scan_batch(files(spark, *FIRST), 0, *args)
    once = results(spark, out)
    watch.scan_batch(files(spark, *FIRST), 0, *args)
    assert results(spark, out) == once and store.version().number == 1
    assert {r.engine for r in spark.read.parquet(f"{out}/findings").collect()} == {"yara"}  # not answered by itself
    watch.scan_batch(files(spark, *SECOND), 1, *args)
    twice, version = results(spark, out), store.version()
    watch.scan_batch(files(spark, *SECOND), 1, *args)
    assert results(spark, out) == twice and store.version() == version
