"""The threat table: hashes of bundles seen before, with one finding each.

Lookups are joins on the hash for all bundles at once; a hit stands for the whole scan (semi join), the rest is
scanned (anti join). The table grows with what was scanned, so Spark chooses the join by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.findings import SEVERITIES, made_order

COLUMNS = "hash string, category string, severity string, description string, added_at timestamp"


def known_findings(hashes: DataFrame, threats: DataFrame) -> DataFrame:
    """Findings of bundles whose hash is known, in full confidence."""
    severity = F.upper("severity")
    return hashes.join(threats, "hash").select(
        "bundle_id", F.lit("bundle").alias("path"), F.lit(None).cast("int").alias("line"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("INFO").alias("severity"), "category",
        F.concat(F.lit("Seen before: "), "description").alias("description"), F.lit("Don't install this bundle").alias("remediation"),
        F.lit("threat_db").alias("engine"), F.lit(1.0).alias("confidence"), F.lit(-1).alias("layer_ord"), F.lit(0).cast("long").alias("n"),
    )


def unknown_bundles(hashes: DataFrame, threats: DataFrame) -> DataFrame:
    return hashes.join(threats.select("hash"), "hash", "left_anti").select("bundle_id", "hash")


def new_threats(findings: DataFrame, hashes: DataFrame) -> DataFrame:
    """What a scan adds: for each hash the last made CRITICAL or HIGH finding, before dedupe."""
    rows = findings.where(F.col("severity").isin("CRITICAL", "HIGH")).join(hashes, "bundle_id")
    order = [c.desc() for c in (F.col("bundle_id"), *made_order())]
    last = Window.partitionBy("hash").orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").select("hash", "category", "severity", "description")


def merged(threats: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of the table: new rows take the place of old ones with the same hash. Both tables are made once, so `new` can be a scan."""
    columns = ("hash", "category", "severity", "description")
    both = threats.select(*columns, F.lit(0).alias("__new")).unionByName(new.select(*columns, F.lit(1).alias("__new")))
    last = F.max("__new").over(Window.partitionBy("hash"))
    return both.withColumn("__last", last).where("__new = __last OR hash IS NULL").select(*columns)


def stats(threats: DataFrame) -> DataFrame:
    return threats.agg(F.count("*").alias("n_threats"))
