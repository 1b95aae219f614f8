"""Folders as a data source, named files as a sink."""

import os
import time

import pytest
from pyspark.sql import functions as F

from palisade.sources import folders, named_files

FILES = {
    "b1/a.md": b"one", "b1/.github/x.md": b"two", "b1/_deep/__init__.py": b"three", "b1/empty": b"", "b2/c.md": b"four", ".b3/_d/.e.md": b"five", "top.md": b"six", "b1/.a.md.crc": b"checksum of Hadoop",
    "b1/.own.crc": b"no checksum: its file isn't there",
}


def made(root, files=FILES):
    for name, data in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return str(root)


def rows(frame):
    return sorted((f"{r.bundle_id}/{r.path}".lstrip("/"), bytes(r.content)) for r in frame.collect())


WANT = sorted((k, v) for k, v in FILES.items() if k != "b1/.a.md.crc")


@pytest.mark.parametrize(("groups", "splits"), [(1, 1), (32, 2), (3, 5)])
def test_every_file_once(spark, tmp_path, groups, splits):
    got = folders.read_files(spark, made(tmp_path), groups=groups, splits=splits)
    assert rows(got) == WANT
    assert {r.bundle_id for r in got.select("bundle_id").collect()} == {"b1", "b2", ".b3", ""}
    assert got.where("size <> octet_length(content) OR changed IS NULL OR error IS NOT NULL").count() == 0


def test_levels(spark, tmp_path):
    root = made(tmp_path)
    assert {(r.bundle_id, r.path) for r in folders.read_files(spark, root, depth=2).where("path = 'x.md'").collect()} == {("b1/.github", "x.md")}
    got = {(r.bundle_id, r.path) for r in folders.read_files(spark, root, skip=1).collect()}
    assert (".github", "x.md") in got and ("", "b1/a.md") in got and ("_d", ".e.md") in got


def test_choices(spark, tmp_path, monkeypatch):
    """Only the folders that can hold what is asked for are listed."""
    root = made(tmp_path)
    assert rows(folders.read_files(spark, root, bundles=["b2", ".b3"])) == [x for x in WANT if x[0].startswith(("b2", ".b3"))]
    assert rows(folders.read_files(spark, root, bundle_start="b", path_start="_deep/")) == [("b1/_deep/__init__.py", b"three")]
    listed, entries = [], folders.entries
    monkeypatch.setattr(folders, "entries", lambda store, folder: listed.append(folder) or entries(store, folder))
    walk = folders.walk_of({"path": root, "groups": "1", "splits": "1", "bundles": '["b1"]', "path_start": ".github/"})
    assert sum(b.num_rows for b in walk.read(folders.Slice(0, 0))) == 1
    assert sorted(x[len(root) :] for x in listed) == ["", "/b1", "/b1/.github"]


def test_a_frame_can_be_used_again(spark, tmp_path):
    """Filters stay with their use: pushed filters of Python sources don't, in Spark 4.1."""
    frame = folders.read_files(spark, made(tmp_path))
    assert frame.where("bundle_id = 'b2'").count() == 1
    assert frame.count() == len(WANT) and frame.where("bundle_id = '.b3'").count() == 1


def test_the_driver_lists_nothing(spark, tmp_path):
    root = made(tmp_path)
    walk = folders.walk_of({"path": f"{root}/not there"})
    assert len(walk.slices()) == 64  # without a look at the folder
    assert rows(folders.read_files(spark, f"{root}/not there")) == []


def test_stream(spark, tmp_path):
    root = made(tmp_path / "in")
    old = time.time() - 100
    for folder, _, names in os.walk(root):
        for name in names:
            os.utime(f"{folder}/{name}", (old, old))

    def run():
        files = spark.readStream.format("bundle_files").option("settle", "0").load(root)
        query = files.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    folders.register(spark)
    assert run() == WANT
    made(tmp_path / "in", {"b2/late.md": b"late", "b1/a.md": b"changed"})
    time.sleep(0.1)
    assert run() == sorted([*WANT, ("b2/late.md", b"late"), ("b1/a.md", b"changed")])


# ---- named files ----


def names(root):
    return sorted(str(p.relative_to(root)).split("/", 2)[-1] for p in root.rglob("*") if p.is_file())


def test_files_have_their_names(spark, tmp_path):
    frame = spark.createDataFrame([("a.json", "{}"), ("../b/c.json", "x"), ("empty", None)], "name string, content string")
    named_files.write_files(frame.repartition(3, "name"), str(tmp_path))
    assert names(tmp_path) == ["a.json", "b/c.json", "empty"]
    assert (next(tmp_path.rglob("c.json"))).read_text() == "x"
    named_files.write_files(frame.where("name = 'a.json'").coalesce(1), str(tmp_path))
    assert names(tmp_path) == ["a.json", "a.json", "b/c.json", "empty"]
    named_files.write_files(frame.where("name = 'empty'").coalesce(1), str(tmp_path), "overwrite")
    assert names(tmp_path) == ["empty"]
    named_files.write_files(frame.where("false"), str(tmp_path / "none"))
    assert names(tmp_path / "none") == []


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    frame = spark.range(20).select(F.concat(F.lit("f"), F.when(F.col("id") == 13, 0).otherwise(F.col("id"))).alias("name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="name of its own"):
        named_files.write_files(frame.coalesce(1), str(tmp_path))
    assert names(tmp_path) == [] and not list(tmp_path.rglob("_staging*"))
    failing = frame.withColumn("content", F.when(F.col("name") == "f19", F.raise_error(F.lit("stop"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        named_files.write_files(failing.repartition(4, "content"), str(tmp_path))
    assert names(tmp_path) == []


def test_there_and_back(spark, tmp_path):
    files = spark.createDataFrame([(f"b{i % 3}", f"d{i % 2}/.f{i}.md", f"text {i}".encode()) for i in range(40)], "bundle_id string, path string, content binary")
    named_files.write_folder(files, str(tmp_path), 4)
    got = folders.read_files(spark, str(tmp_path), skip=2)
    assert sorted((r.bundle_id, r.path, bytes(r.content)) for r in got.collect()) == sorted((r.bundle_id, r.path, bytes(r.content)) for r in files.collect())
