"""Nested marked folders, and the streaming digests behind them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palisade.operators import bundles, digest, scan_all
from palisade.operators.findings import SEVERITIES

SCHEMA = "bundle_id string, path string, text string, content binary"


def frame(spark, rows):
    return spark.createDataFrame([(b, p, t, t.encode()) for b, p, t in rows], SCHEMA)


FILES = [
    ("b", "SKILL.md", "top"),
    ("b", "a.txt", "os.system( in the root"),
    ("b", "a/SKILL.md", "nested"),
    ("b", "a/.cursorrules", "second marker"),
    ("b", "a/x.md", "an agent that can impersonate"),
    ("b", "a/b/c/y.md", "pickle.load( deep"),
    ("b", "a/b/c/.clauderules", "deepest"),
    ("b", "ab/z.md", "not below a"),
    ("c", "x/y.md", "no marker: os.system("),
    ("d", "p/SKILL.md/really/a.md", "a folder with a marker's name"),
    ("d", "p/.cursorrules", "nothing bad"),
]


def subtree(rows, bundle, folder):
    """(path components, text) below a folder, in the order of their components."""
    start = folder + "/" if folder else ""
    return sorted((p[len(start) :].split("/"), t) for b, p, t in rows if b == bundle and p.startswith(start))


def test_nested_scans(spark):
    results, kept, new = scan_all.scan_all(frame(spark, FILES))
    got = {(r.bundle_id, r.folder): r for r in results.collect()}
    assert set(got) == {("b", ""), ("b", "a"), ("b", "a/b/c"), ("d", "p")}
    for (bundle, folder), r in got.items():
        files = subtree(FILES, bundle, folder)
        assert r.n_files == len(files)
        assert r.hash == hashlib.sha256("".join(t for _, t in files).encode()).hexdigest()
    assert {k: r.n_scans for k, r in got.items()} == {("b", ""): 1, ("b", "a"): 2, ("b", "a/b/c"): 1, ("d", "p"): 1}
    assert {k: r.risk_level for k, r in got.items()} == {("b", ""): "DANGEROUS", ("b", "a"): "DANGEROUS", ("b", "a/b/c"): "DANGEROUS", ("d", "p"): "SAFE"}
    found = sorted((r.bundle_id.folder, r.path, r.severity) for r in kept.collect())
    assert found == [("", "a.txt", "CRITICAL"), ("", "a/b/c/y.md", "CRITICAL"), ("", "a/x.md", "HIGH"), ("a", "b/c/y.md", "CRITICAL"), ("a", "x.md", "HIGH"), ("a/b/c", "y.md", "CRITICAL")]
    assert new.count() == 3 and set(SEVERITIES) >= {r.severity for r in new.collect()}


def test_known_scans_are_answered(spark):
    files = frame(spark, FILES)
    _, _, new = scan_all.scan_all(files)
    known = new.withColumn("added_at", F.current_timestamp())
    results, kept, again = scan_all.scan_all(files, known)
    assert {r.engine for r in kept.collect()} == {"threat_db"} and again.count() == 0
    assert sorted((r.folder, r.n_findings) for r in results.collect()) == [("", 1), ("a", 1), ("a/b/c", 1), ("p", 0)]


def test_a_root_with_many_folders(spark):
    rows = [("big", "SKILL.md", "m")] + [("big", f"f{i}/g{i % 7}/x.md", "call os.popen( x" if i % 10 == 0 else "plain") for i in range(300)]
    results, kept, _ = scan_all.scan_all(frame(spark, rows))
    (only,) = results.collect()
    assert (only.folder, only.n_files, only.n_findings) == ("", 301, 30) and kept.count() == 30
    salts = scan_all.salted(frame(spark, rows), F.col("path")).groupBy("salt").count().collect()
    assert len(salts) == scan_all.SALTS and max(r["count"] for r in salts) < 100


def test_no_files(spark):
    results, kept, new = scan_all.scan_all(frame(spark, []))
    assert results.count() == kept.count() == new.count() == 0


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_digests_are_those_of_whole_files(spark, monkeypatch, size):
    monkeypatch.setattr(digest, "PIECE_BYTES", size)
    rows = [*FILES, ("e", "empty.md", ""), ("e", "ü.md", "äöü" * 5), ("f", "only.md", "")]
    got = {r.bundle_id: r.hash for r in bundles.bundle_hashes(frame(spark, rows)).collect()}
    want = {b: hashlib.sha256("".join(t for _, t in subtree(rows, b, "")).encode()).hexdigest() for b in "bcdef"}
    assert got == want
    bodies = {b: "\n\n".join(f"=== {'/'.join(p)} ===\n{t}" for p, t in subtree(rows, b, "")) for b in "bcdef"}
    texts = {r.bundle_id: (r.body_sha256, r.n_chars) for r in bundles.text_digests(frame(spark, rows)).collect()}
    assert texts == {b: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for b, t in bodies.items()}


def test_nulls(spark):
    rows = spark.createDataFrame([("b", "a.bin", None, b"\xff\xfe"), ("b", "b.md", None, None), ("b", "c.md", "x", b"x")], SCHEMA)
    (r,) = bundles.bundle_hashes(rows).collect()
    assert r.hash == hashlib.sha256(b"\xff\xfex").hexdigest()
    (t,) = bundles.text_digests(rows).collect()
    assert t.n_chars == len("=== c.md ===\nx")


@pytest.mark.parametrize("n_bytes", [1, 30, 200, 10_000])
def test_heads(spark, n_bytes):
    rows = [("b", f"{i:03d}.md", "wörd " * (i % 4)) for i in range(60)] + [("long", "a.md", "x" * 50_000), ("long", "b.md", "y")]
    body = {}
    for b in ("b", "long"):
        body[b] = "\n\n".join(f"=== {'/'.join(p)} ===\n{t}" for p, t in subtree(rows, b, ""))
    for r in bundles.bundle_heads(frame(spark, rows), n_bytes).collect():
        cut = body[r.bundle_id].encode()[:n_bytes]
        assert r.body.encode()[:n_bytes] == cut and len(r.body.encode()) < 3 * n_bytes + 100


def test_joins_of_contents_sort_nothing(spark, capsys):
    files = frame(spark, FILES)
    scans = scan_all.enclosing(files)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scans = scan_all.stored(scans, "folders")
        for joined in (scan_all.within(files, scans), scan_all.in_scans(files.select("bundle_id", "path", "content"), scans)):
            joined.explain()
            plan = capsys.readouterr().out
            assert "ShuffledHashJoin" in plan and "Sort" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_files_within_scans_keep_their_texts(spark):
    rows = [("b", "SKILL.md", "as in its bytes", b"as in its bytes"), ("b", "x.md", None, b"\xff\xfe"), ("b", "y.md", "another", b"bytes"), ("b", "z.md", "no bytes", None), ("b", "n.md", None, None), ("c", "x.md", "no marker", b"no marker")]
    files = spark.createDataFrame(rows, SCHEMA)
    got = scan_all.within(files, scan_all.enclosing(files)).collect()
    assert sorted((r.bundle_id, r.path, r.text, None if r.content is None else bytes(r.content)) for r in got) == sorted(rows[:-1], key=lambda r: r[1])


def test_digest_tasks_grow_with_the_bytes_of_all_scans(spark, monkeypatch):
    seen, real = [], digest.digests
    monkeypatch.setattr(digest, "digests", lambda *args, **more: seen.append(more["tasks"]) or real(*args, **more))
    monkeypatch.setattr(scan_all, "TASK_BYTES", 100)
    for n in (1, 4):
        results, _, _ = scan_all.scan_all(frame(spark, [(b, p, t * 100 * n) for b, p, t in FILES]))
        assert results.count() == 4
    in_scans = sum(len(t) for b, d in (("b", ""), ("b", "a"), ("b", "a/b/c"), ("d", "p")) for _, t in subtree(FILES, b, d))
    assert seen == [in_scans, 4 * in_scans]
