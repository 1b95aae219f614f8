"""How much Python is handed at a time by the steps that see whole files."""

import pytest
from pyspark.sql import functions as F

from palisade import session
from palisade.operators import reports
from palisade.sources import named_files

TEXT = "x" * 100_000


def sizes(spark, monkeypatch, tmp_path, run):
    """The largest batch, in bytes, of each module's step that run() makes; each batch leaves a file."""
    out = tmp_path / "sizes"
    out.mkdir()
    monkeypatch.setattr(session, "BATCH_BYTES", 1 << 20)
    real = type(spark.range(1)).mapInArrow

    def noted(self, fn, *args, **more):
        def counted(batches, at=str(out)):
            import uuid

            def each():
                for batch in batches:
                    open(f"{at}/{batch.nbytes}-{uuid.uuid4().hex}", "w").close()
                    yield batch

            return fn(each())

        return real(self, counted, *args, **more)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", noted)
    run()
    return [int(p.name.split("-")[0]) for p in out.iterdir()]


def test_a_scan_hands_python_little_at_a_time(spark, monkeypatch, tmp_path):
    files = spark.range(0, 100, 1, 1).select(F.lit("b").alias("bundle_id"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit(TEXT).alias("text"))
    files = files.withColumn("content", F.col("text").cast("binary"))
    before = spark.conf.get(session.BATCH_CONF)
    found = sizes(spark, monkeypatch, tmp_path, lambda: reports.scan(files))
    assert sum(found) >= 2 * 100 * len(TEXT) and max(found) < 3 << 20  # hashes and findings
    assert spark.conf.get(session.BATCH_CONF) == before


def test_the_setting_comes_back_after_an_error(spark, tmp_path):
    before = spark.conf.get(session.BATCH_CONF)
    with pytest.raises(Exception):
        named_files.write_files(spark.createDataFrame([("", b"x")], "name string, content binary"), str(tmp_path / "files"))
    assert spark.conf.get(session.BATCH_CONF) == before
