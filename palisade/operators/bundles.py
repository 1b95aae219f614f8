"""Bundles: hash, joined text, scripts and marker files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import digest

MARKERS = ("SKILL.md", ".clauderules", ".cursorrules")
RUNTIMES = {"py": "python", "js": "node", "mjs": "node", "cjs": "node", "sh": "shell"}
MAX_DEPTH = 4
BETWEEN = "\n\n"  # stands between two files of a bundle's text


def bundle_hashes(files: DataFrame) -> DataFrame:
    """(bundle_id, hash): SHA-256 of the bytes of all files end to end, ordered by path components, without their names."""
    made = digest.digests(digest.pieces(files, ["bundle_id"], F.col("content")), ["bundle_id"])
    return made.select("bundle_id", F.col("sha256").alias("hash"))


def shown_text() -> Column:
    """A readable file under a line with its path."""
    return F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "text")


def text_digests(files: DataFrame) -> DataFrame:
    """(bundle_id, body_sha256, n_chars) of the text that all readable files of a bundle make, each as shown_text() and
    an empty line between two. The text itself is never one row; bundle_heads() gives its beginning."""
    readable = files.where(F.col("text").isNotNull())
    cut = digest.pieces(readable, ["bundle_id"], shown_text().cast("binary"), F.length(shown_text()))
    return digest.digests(cut, ["bundle_id"], BETWEEN.encode()).select("bundle_id", F.col("sha256").alias("body_sha256"), F.col("chars").alias("n_chars"))


def bundle_heads(files: DataFrame, n_bytes: int) -> DataFrame:
    """(bundle_id, body): the beginning of that text, of n_bytes bytes at least where it has as many.

    A file's line takes more than ten bytes, so only so many first files can matter; Spark picks them before the shuffle."""
    by_path = Window.partitionBy("bundle_id").orderBy("parts")
    head = F.concat(F.lit("=== "), "path", F.lit(" ===\n"), F.substring("text", 1, n_bytes))
    rows = files.where(F.col("text").isNotNull()).select("bundle_id", F.split("path", "/").alias("parts"), head.alias("head"))
    first = rows.withColumn("at", F.row_number().over(by_path)).where(F.col("at") <= n_bytes // 10 + 1)
    size = F.octet_length("head") + len(BETWEEN)
    before = F.sum(size).over(by_path.rowsBetween(Window.unboundedPreceding, -1))
    # A file that begins at the limit, or a byte after it, is needed for what stands between it and the one before.
    needed = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n_bytes + len(BETWEEN))
    parts = F.array_sort(F.collect_list(F.struct("at", "head")))
    return needed.groupBy("bundle_id").agg(F.array_join(F.transform(parts, lambda x: x["head"]), BETWEEN).alias("body"))


def scripts(files: DataFrame) -> DataFrame:
    """(bundle_id, path, runtime) of scripts at most MAX_DEPTH levels deep."""
    runtime = F.create_map(*[F.lit(x) for pair in RUNTIMES.items() for x in pair])[T.extension(F.col("path"))]
    return files.where(F.size(F.split("path", "/")) <= MAX_DEPTH).select("bundle_id", "path", runtime.alias("runtime")).where(F.col("runtime").isNotNull())


def marked_folders(files: DataFrame) -> DataFrame:
    """(bundle_id, folder, n_markers): folders that hold marker files; each marker asks for a scan of its folder."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where(T.base_name(F.col("path")).isin(*MARKERS)).groupBy("bundle_id", folder.alias("folder")).agg(F.count("*").alias("n_markers"))
