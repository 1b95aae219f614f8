"""Addresses within limits, and archives as a table function."""

import io
import tarfile
import zipfile

from palisade.sources import fetch, readers
from palisade.sources.fetch import Answer
from tests.test_sources import tarred, zipped


def made_opener():
    """An opener that tasks can be given: they can't import the tests."""

    def opener(address):
        """By the address alone, as tasks can't share state."""
        kind = address.split("/")[3]
        if kind == "declared":
            def never():
                raise AssertionError("read, though it declared too much")
                yield
            return Answer(200, 101, never())
        if kind == "streamed":
            def much():
                for i in range(100):
                    assert i < 3, "read on after the limit"
                    yield b"x" * 50
            return Answer(200, None, much())
        if kind == "liar":
            return Answer(200, 5, [b"x" * 99, b"yy"])
        if kind == "error":
            raise ConnectionError("no")
        if kind == "status":
            return Answer(int(address.split("/")[4]))
        if kind == "api":
            return Answer(200, None, [b'{"source_url": "https://a.b/ok/named.md"}']) if "/known/" in address else Answer(200, None, [b'{"source_url": 5}'])
        return Answer(200, 100, [b"x" * 50, b"y" * 50])

    return opener


opener = made_opener()


def test_limits(spark):
    kinds = ["ok/a.md", "declared/a", "streamed/a", "liar/a", "error/a", "status/404", "status/503", "status/204"]
    rows = spark.createDataFrame([(k, f"https://a.b/{k}") for k in kinds] + [("null", None)], "bundle_id string, address string")
    got = {r.bundle_id: (r.path, r.content and len(r.content), r.reason) for r in fetch.fetched(rows, opener, most=100, pause=0).collect()}
    assert got["ok/a.md"] == ("a.md", 100, None) and got["status/204"][2] is None
    assert {k: v[2] for k, v in got.items() if v[2]} == {
        "declared/a": "declares more than 100 bytes", "streamed/a": "holds more than 100 bytes", "liar/a": "holds more than 100 bytes",
        "error/a": "failed: ConnectionError", "status/404": "status 404", "status/503": "status 503", "null": "no address",
    }


def test_tries():
    calls = []

    def flaky(address):
        calls.append(address)
        if len(calls) == 1:
            raise TimeoutError
        return Answer(503) if len(calls) == 2 else Answer(200, None, [b"at last"])

    assert fetch.fetch_one("x", flaky, 10, 3, 0) == (b"at last", None)
    calls.clear()
    assert fetch.fetch_one("x", flaky, 10, 2, 0) == (None, "status 503")
    assert fetch.fetch_one("x", lambda a: calls.append(a) or Answer(404), 10, 5, 0) == (None, "status 404")
    assert len(calls) == 3  # a 404 isn't asked again


def test_resolve(spark):
    sources = [("skills.sh/known/repo", None), ("skills.sh/other/repo", None), ("https://a.b/ok/x.md", None), ("https://a.b/declared/x.md", None), ("skills.sh/nothing", None), ("x.rar", "file"), ("here.md", "file"), ("gone.md", None)]
    files, rejected = fetch.resolve(spark.createDataFrame(sources, "source string, local string"), opener, most=100, pause=0)
    got = {r.bundle_id: r.path for r in files.collect()}
    assert got == {"skills.sh/known/repo": "named.md", "skills.sh/other/repo": "SKILL.md", "https://a.b/ok/x.md": "x.md"}
    assert {r.source: (r.kind, r.reason) for r in rejected.collect()} == {
        "https://a.b/declared/x.md": ("url", "declares more than 100 bytes"), "skills.sh/nothing": ("invalid", "the reference names nothing"),
        "x.rar": ("unsupported", "this type isn't read"), "gone.md": ("missing", "nothing lies there"),
    }


def lying_zip():
    """A zip whose header declares one byte for a file of many."""
    data = bytearray(zipped([("a.md", b"x" * 1000)]))
    at = data.rindex(b"PK\x01\x02")
    data[at + 24 : at + 28] = (1).to_bytes(4, "little")
    return bytes(data)


def linked_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, kind, target in (("l.md", tarfile.SYMTYPE, "/etc/passwd"), ("h.md", tarfile.LNKTYPE, "a.md"), ("d", tarfile.DIRTYPE, ""), ("f", tarfile.FIFOTYPE, "")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, target
            t.addfile(info)
        info = tarfile.TarInfo("a.md")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return out.getvalue()


def test_table_function(spark):
    readers.register_unpack(spark)
    many = zipped([(f"f{i}", b"") for i in range(readers.MAX_ENTRIES + 1)])
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.md", b"not read either")
        z.writestr("zeros", bytes(readers.MAX_FILE_BYTES + 1))
    big_tar = tarred([("zeros", bytes(readers.MAX_FILE_BYTES + 1))])
    rows = [
        ("slip", "zip", zipped([("../../a.md", b"1"), ("/b.md", b"2"), ("c\\..\\d.md", b"3"), ("..", b"4")])), ("links", "tar", linked_tar()), ("bomb", "zip", bomb.getvalue()), ("big", "tar", big_tar), ("many", "zip", many),
        ("cut", "tar", tarred([("a", b"x" * 9999)])[:-20]), ("cut zip", "zip", zipped([("a", b"x")])[:-4]), ("empty", "zip", zipped([])), ("odd", "rar", b""), ("null", None, None), ("liar", "zip", lying_zip()),
    ]
    spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "bundle_id string, kind string, content binary").createOrReplaceTempView("archives")
    got = spark.sql("SELECT bundle_id, e.* FROM archives a, LATERAL unpack(a.kind, a.content) e").collect()
    files = {(r.bundle_id, r.path, bytes(r.content)) for r in got if r.reason is None}
    assert files == {("slip", "a.md", b"1"), ("slip", "b.md", b"2"), ("slip", "c/d.md", b"3"), ("links", "a.md", b"abc")}
    reasons = {r.bundle_id: r.reason for r in got if r.reason is not None}
    assert set(reasons) == {"bomb", "big", "many", "cut", "cut zip", "odd", "null", "liar"}
    assert "more than 26214400 bytes" in reasons["bomb"] and "more than 26214400 bytes" in reasons["big"] and "10000 entries" in reasons["many"]
