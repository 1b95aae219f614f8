"""Scans of all marked folders in one job.

Each folder that holds a marker file is scanned with everything below it, so a nested marker gives a further scan of a part of the
files. Folders, not files, are exploded by their ancestors and joined with the marked ones; files then find their scans by
the folder they lie in. Detectors see a file once, however many scans it belongs to: what is multiplied are findings, and pieces for
the digests. Both joins are salted, so that a root with most of the folders, or a folder with most of the files, is
shared by SALTS tasks.

Files meet their folders in joins that hash the folders, so that contents stream past and no task sorts them. Only the digests need a
sort; its number of tasks grows with the bytes that the scans see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import bundles, detect, digest, findings, threats
from palisade.session import stored

SALTS = 8
#: Bytes of files, each once for each of its scans, that a task sorts for the digests.
TASK_BYTES = 64 << 20


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def salted(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def enclosing(files: DataFrame) -> DataFrame:
    """(bundle_id, own, folder, n_bytes): each folder that holds files, and the bytes of those, with each marked folder at or above it."""
    marked = repeated(bundles.marked_folders(files).select(F.col("bundle_id").alias("in_bundle"), "folder"))
    size = F.sum(F.coalesce(F.octet_length("content"), F.lit(0)))
    own = files.groupBy("bundle_id", folder_of(F.col("path")).alias("own")).agg(size.alias("n_bytes"))
    parts = F.when(F.col("own") == "", F.array().cast("array<string>")).otherwise(F.split("own", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = salted(own.select("bundle_id", "own", "n_bytes", F.explode(above).alias("above")), F.col("own"))
    met = (asked.bundle_id == marked.in_bundle) & (asked.above == marked.folder) & (asked.salt == marked.salt)
    return asked.join(marked, met).select("bundle_id", "own", "folder", "n_bytes")


def in_scans(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """rows (bundle_id, path, ...) once for each scan of their folder: bundle_id becomes (bundle, folder), path starts at the folder."""
    left = salted(rows.withColumn("own", folder_of(F.col("path"))), F.col("path"))
    out = left.join(repeated(scans.select("bundle_id", "own", "folder")).hint("shuffle_hash"), ["bundle_id", "own", "salt"])
    start = F.when(F.col("folder") == "", 1).otherwise(F.length("folder") + 2)
    scan = F.struct(F.col("bundle_id").alias("bundle"), "folder")
    path = F.substring(F.col("path"), start, F.length("path"))
    return out.withColumn("path", path).withColumn("bundle_id", scan).select(*rows.columns)


def within(files: DataFrame, scans: DataFrame) -> DataFrame:
    """The files that some scan sees, each once. A text that its content tells is not shuffled beside it."""
    same = F.coalesce(F.col("text").cast("binary") == F.col("content"), F.lit(False))
    rows = files.select("bundle_id", "path", "content", same.alias("same"), F.when(~same, F.col("text")).alias("other"))
    rows = salted(rows.withColumn("own", folder_of(F.col("path"))), F.col("path"))
    folders = repeated(scans.select("bundle_id", "own").distinct()).hint("shuffle_hash")
    text = F.when(F.col("same"), F.col("content").cast("string")).otherwise(F.col("other"))
    return rows.join(folders, ["bundle_id", "own", "salt"], "left_semi").select("bundle_id", "path", text.alias("text"), "content")


def scan_all(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, findings, new threats) of the scans of all marked folders of files (bundle_id, path, text, content).

    results: (bundle_id, folder, n_scans, n_files, hash, n_findings, risk_score, risk_level); n_scans counts the folder's marker files,
    each of which asks for the same scan. findings name their scan in bundle_id, a struct (bundle, folder). known: a threat table; the
    scans whose hash it holds are answered from it. All scans of a job see one state of it, and new threats are for its next."""
    scans = stored(enclosing(files), "scan-folders")
    n_bytes = scans.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    cut = in_scans(files.select("bundle_id", "path", "content"), scans)
    hashes = digest.digests(digest.pieces(cut, ["bundle_id"], F.col("content")), ["bundle_id"], tasks=tasks)
    hashes = stored(hashes.select("bundle_id", F.col("sha256").alias("hash"), "n_files"), "scan-hashes", small=True)
    found = stored(in_scans(detect.static_findings(within(files, scans)), scans), "scan-findings", small=True)
    made = found
    if known is not None:
        made = found.join(threats.unknown_bundles(hashes, known).select("bundle_id"), "bundle_id", "left_semi")
        kept = findings.dedupe(made.unionByName(threats.known_findings(hashes.select("bundle_id", "hash"), known)))
    else:
        kept = findings.dedupe(made)
    markers = bundles.marked_folders(files).select(F.struct(F.col("bundle_id").alias("bundle"), "folder").alias("bundle_id"), F.col("n_markers").alias("n_scans"))
    results = findings.scores(kept, hashes).join(hashes, "bundle_id").join(markers, "bundle_id")
    results = results.select(F.col("bundle_id.bundle").alias("bundle_id"), F.col("bundle_id.folder").alias("folder"), "n_scans", "n_files", "hash", "n_findings", "risk_score", "risk_level")
    return results, kept, threats.new_threats(made, hashes.select("bundle_id", "hash"))
