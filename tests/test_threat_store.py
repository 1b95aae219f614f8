"""The versioned threat table: copy on write, dead writers, conflicts, batches."""

from pathlib import Path

import pytest

from palisade.operators.threat_store import Conflict, ThreatStore

SCHEMA = "hash string, category string, severity string, description string"


def rows(spark, *pairs):
    return spark.createDataFrame([(h, "c", s, "d") for h, s in pairs], SCHEMA)


def state(store, number=None):
    return {r.hash: r.severity for r in store.read(number).collect()}


def test_upserts_and_versions(spark, tmp_path):
    store = ThreatStore(spark, f"{tmp_path}/t", 8)
    assert state(store) == {} and store.version().number == 0
    store.upsert(rows(spark, *[(f"h{i}", "HIGH") for i in range(50)]))
    store.upsert(rows(spark, ("h3", "CRITICAL"), ("new", "HIGH")))
    want = {f"h{i}": "HIGH" for i in range(50)}
    assert state(store, 1) == want
    assert state(store) == want | {"h3": "CRITICAL", "new": "HIGH"}
    assert store.read().count() == 51 and store.read().where("added_at IS NULL").count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = ThreatStore(spark, f"{tmp_path}/t", 8)
    first = store.upsert(rows(spark, *[(f"h{i}", "HIGH") for i in range(50)]))
    second = store.upsert(rows(spark, ("h7", "CRITICAL")))
    changed = [b for b in second.buckets if second.buckets[b] != first.buckets.get(b)]
    assert len(first.buckets) == 8 and len(changed) == 1
    folder = second.buckets[changed[0]].split("/")[0]
    assert [p.name for p in Path(f"{tmp_path}/t/data/{folder}/all").glob("bucket=*")] == [f"bucket={changed[0]}"]


def test_dead_writer(spark, tmp_path, monkeypatch):
    """What is written but not published isn't seen, and the next writer isn't held up."""
    store = ThreatStore(spark, f"{tmp_path}/t", 4)
    store.upsert(rows(spark, ("a", "HIGH")))

    def dies(version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows(spark, ("a", "CRITICAL"), ("b", "HIGH")))
    assert state(ThreatStore(spark, f"{tmp_path}/t", 4)) == {"a": "HIGH"}
    store.upsert(rows(spark, ("c", "HIGH")))
    assert state(store) == {"a": "HIGH", "c": "HIGH"}
    kept = {x.split("/")[0] for x in store.version().buckets.values()}
    assert len(store.vacuum(keep=1)) >= 1 and state(store) == {"a": "HIGH", "c": "HIGH"}
    assert {p.name for p in Path(f"{tmp_path}/t/data").iterdir()} == kept


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower of two writers with one base starts again, and both sets of rows are there, also in one bucket."""
    one, two = (ThreatStore(spark, f"{tmp_path}/t", 1) for _ in range(2))
    one.upsert(rows(spark, ("a", "HIGH")))
    publish, calls = two._publish, []

    def late(version):
        if not calls:
            one.upsert(rows(spark, ("b", "CRITICAL"), ("a", "CRITICAL")))
        calls.append(version.number)
        publish(version)

    monkeypatch.setattr(two, "_publish", late)
    two.upsert(rows(spark, ("c", "HIGH")))
    assert calls == [2, 3]
    assert state(one) == {"a": "CRITICAL", "b": "CRITICAL", "c": "HIGH"}


def test_a_taken_number(spark, tmp_path):
    store = ThreatStore(spark, f"{tmp_path}/t", 2)
    version = store.upsert(rows(spark, ("a", "HIGH")))
    with pytest.raises(Conflict):
        store._publish(version)
    assert state(store) == {"a": "HIGH"}


def test_batches_count_once(spark, tmp_path):
    store = ThreatStore(spark, f"{tmp_path}/t", 4)
    store.upsert(rows(spark, ("a", "HIGH")), "s", 0)
    store.upsert(rows(spark, ("b", "HIGH")), "s", 1)
    before = store.version()
    assert before.applied == {"s": [1, 1]}
    store.upsert(rows(spark, ("b", "CRITICAL"), ("z", "HIGH")), "s", 1)
    store.upsert(rows(spark, ("y", "HIGH")), "s", 0)
    assert store.version() == before and state(store) == {"a": "HIGH", "b": "HIGH"}
    store.upsert(rows(spark, ("z", "HIGH")), "other", 0)
    assert store.version().applied == {"s": [1, 1], "other": [0, 2]}


def test_nothing_new(spark, tmp_path):
    store = ThreatStore(spark, f"{tmp_path}/t", 4)
    store.upsert(rows(spark, ("a", "HIGH")))
    store.upsert(rows(spark))
    store.upsert(spark.createDataFrame([(None, "c", "HIGH", "d")], SCHEMA))
    assert store.version().number == 1
    store.upsert(rows(spark), "s", 0)  # an empty batch is remembered
    assert store.version().applied == {"s": [0, 1]} and state(store) == {"a": "HIGH"}
