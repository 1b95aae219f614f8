import gzip
import io
import random
import tarfile
import zipfile

import pytest

from palisade.sources import readers, router
from pyspark.sql import functions as F


def test_router(spark):
    rows = [("lobehub.com/skills/x/y", None), ("skills.sh/a/b/c", None), ("a/b", None), ("a/b", "directory"), ("a/b/c", None), ("ftp://a/b", None), ("http://a", None), ("x.tar.gz", "file"), ("x.tar", "file"), ("..", "directory")]
    got = [r.kind for r in router.routed(spark.createDataFrame(rows, "source string, local string")).collect()]
    assert got == ["hub", "registry", "shorthand", "directory", "missing", "missing", "url", "tar", "unsupported", "directory"]


def test_file_names(spark):
    urls = ["https://a.b/c/d.md?x=1", "https://a.b/", "https://a.b", "no url"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(router.file_name_of(F.col("u"))).collect()]
    assert got == ["d.md", "downloaded_skill.txt", "downloaded_skill.txt", "no url"] or got[:3] == ["d.md", "downloaded_skill.txt", "downloaded_skill.txt"]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, monkeypatch):
    entries = [("a.md", b"one"), ("../up/b.md", b"two"), ("/root.md", b"three")]
    rows = [("z", "zip", bytearray(zipped(entries))), ("t", "tar", bytearray(tarred(entries))), ("bad", "zip", bytearray(b"no zip")), ("null", "tar", None), ("odd", "rar", bytearray(b""))]
    files, rejected = readers.unpack(spark.createDataFrame(rows, "bundle_id string, kind string, content binary"))
    assert {(r.bundle_id, r.path, r.text) for r in files.collect()} == {(b, p, t) for b in "zt" for p, t in (("a.md", "one"), ("up/b.md", "two"), ("root.md", "three"))}
    assert {r.bundle_id for r in rejected.collect()} == {"bad", "null", "odd"}
    monkeypatch.setattr(readers, "MAX_TOTAL_BYTES", 5)
    for make, open_ in ((zipped, readers.unzip), (tarred, readers.untar)):
        try:
            open_(make(entries))
            raise AssertionError
        except ValueError as e:
            assert "more than" in str(e)


def test_folder_with_hidden_files(spark, tmp_path):
    for name, data in (("b1/a.md", b"x"), ("b1/.cursorrules", b"y"), ("b2/d/e.md", b"\xff")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {(r.bundle_id, r.path, r.text) for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert rows == {("b1", "a.md", "x"), ("b1", ".cursorrules", "y"), ("b2", "d/e.md", None)}
    one = readers.read_file(spark, str(tmp_path / "b1/a.md")).first()
    assert (one.path, one.text) == ("a.md", "x")


def test_a_cut_archive_is_rejected_wherever_it_is_cut(spark):
    noise = random.Random(3)
    whole = tarred([(f"f{i}.md", bytes(noise.randrange(256) for _ in range(700))) for i in range(6)])
    rows = [(str(n), "tar", bytearray(whole[:n])) for n in range(0, len(whole) + 1, 16)] + [("whole", "tar", bytearray(whole))]
    files, rejected = readers.unpack(spark.createDataFrame(rows, "bundle_id string, kind string, content binary").repartition(4))
    cut = {r[0] for r in rows if len(r[2]) < len(whole)}
    assert {r.bundle_id for r in rejected.collect()} == cut and len(cut) > 200
    assert {(r.bundle_id, r.path) for r in files.collect() if r.bundle_id == "whole"} == {("whole", f"f{i}.md") for i in range(6)}
    assert not {r.bundle_id for r in files.collect()} & cut


def test_a_tar_with_a_broken_or_cut_header_is_rejected():
    plain = gzip.decompress(tarred([("a.md", b"one"), ("b.md", b"two")]))
    broken = plain[:1024] + b"x" + plain[1025:]
    for data in (broken, plain[:1300]):
        with pytest.raises(tarfile.ReadError):
            readers.untar(gzip.compress(data))
    assert list(readers.untar(gzip.compress(plain[:2048]))) == [("a.md", b"one"), ("b.md", b"two")]  # no end marker, but whole
