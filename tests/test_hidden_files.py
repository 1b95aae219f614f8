"""Files that Spark's index leaves out: hidden names and everything below hidden folders, once each."""

from palisade.sources import readers

FILES = {
    ("b1", "a.md"): b"plain", ("b1", "__init__.py"): b"x = 1", ("b1", "_setup.sh"): b"true", ("b1", ".cursorrules"): b"y", ("b1", ".github/copilot-instructions.md"): b"z",
    ("b1", ".cursor/rules/_deep/c d%20\u00e9.md"): b"odd name", ("b1", "_metadata.py"): b"dropped", ("b1", "_metadata/h.md"): b"kept by Spark", ("b1", "empty.md"): b"", ("b1", "_k=v/e.md"): b"kept by Spark", ("b1", "f._COPYING_"): b"half", (".b2", "g.md"): b"hidden bundle",
    ("b1", ".data.gz"): b"no gzip", ("b1", ".empty"): b"",
}


def test_every_file_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_FILE_BYTES", 3)  # the limit of archives is none of a folder's files
    root = tmp_path / ".hidden" / "root"
    for (bundle, path), data in FILES.items():
        at = root / bundle / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    got = sorted((r.bundle_id, r.path, bytes(r.content)) for r in readers.read_folder(spark, str(root)).collect())
    assert got == sorted((b, p, d) for (b, p), d in FILES.items())
    for name in (".cursorrules", "__init__.py", "a.md", ".data.gz"):
        one = readers.read_file(spark, str(root / "b1" / name)).collect()
        assert [(r.path, bytes(r.content)) for r in one] == [(name, FILES["b1", name])]
