"""Findings to verdicts: dedupe, risk score and level, the gate, ranking and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from least to most, with weights.
SEVERITIES = {"INFO": 0.0, "LOW": 1.0, "MEDIUM": 4.0, "HIGH": 7.0, "CRITICAL": 9.0}
DANGEROUS_SCORE, CAUTION_SCORE, MOST, REPEAT_BONUS = 7.0, 4.0, 10.0, 0.5


def severity_order(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in SEVERITIES.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def clamp(confidence: Column) -> Column:
    return F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))


def made_order() -> list[Column]:
    """The order in which a scan makes its findings: by detector, path component by component, and place."""
    return [F.col("layer_ord"), F.split("path", "/"), F.col("n")]


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding for each (bundle, category, path, line): the most confident, the first made of equals. Severity plays no part."""
    same = Window.partitionBy("bundle_id", "category", "path", "line").orderBy(F.col("confidence").desc(), *made_order())
    return findings.withColumn("__rank", F.row_number().over(same)).where("__rank = 1").drop("__rank")


def scores(findings: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle_id, n_findings, risk_score, risk_level) of every bundle; those without findings score 0 and are SAFE."""
    by_engine = findings.groupBy("bundle_id", "engine").agg(
        F.count("*").alias("n"), F.sum(severity_weight(F.col("severity")) * F.col("confidence")).alias("base"), F.max(severity_order(F.col("severity"))).alias("worst")
    )
    by_bundle = by_engine.groupBy("bundle_id").agg(F.sum("n").alias("n_findings"), F.sum("base").alias("base"), F.sum((F.col("n") - 1) * REPEAT_BONUS).alias("bonus"), F.max("worst").alias("worst"))
    score = F.least(F.lit(MOST), F.least(F.lit(MOST), F.col("base")) + F.col("bonus"))
    rows = bundles.select("bundle_id").join(by_bundle, "bundle_id", "left").withColumn("risk_score", F.when(F.col("base").isNull(), 0.0).otherwise(score))
    level = (
        F.when(F.col("worst") == 4, "DANGEROUS").when(F.col("worst") == 3, "CAUTION").when(F.col("risk_score") >= DANGEROUS_SCORE, "DANGEROUS").when(F.col("risk_score") >= CAUTION_SCORE, "CAUTION").otherwise("SAFE")
    )
    return rows.select("bundle_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "risk_score", level.alias("risk_level"))


def gate(findings: DataFrame, bundles: DataFrame, fail_on: str) -> DataFrame:
    """(bundle_id, fails): whether a bundle has a finding of at least this severity."""
    least = list(SEVERITIES).index(fail_on.upper())
    bad = findings.groupBy("bundle_id").agg(F.bool_or(severity_order(F.col("severity")) >= least).alias("fails"))
    return bundles.select("bundle_id").join(bad, "bundle_id", "left").select("bundle_id", F.coalesce("fails", F.lit(False)).alias("fails"))


def ranked(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Findings with their display rank in the bundle: severity, then confidence, then the order made; at most `most`."""
    order = Window.partitionBy("bundle_id").orderBy(severity_order(F.col("severity")).desc(), F.col("confidence").desc(), *made_order())
    out = findings.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.where(F.col("rank") <= most)


def first_made(findings: DataFrame, most: int) -> DataFrame:
    """The first findings of each bundle, with their number."""
    order = Window.partitionBy("bundle_id").orderBy(*made_order())
    return findings.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)


def engine_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("bundle_id", "engine").agg(F.count("*").alias("n_findings"))


def class_rollup(findings: DataFrame) -> DataFrame:
    """Counts by class and severity with subtotals (an extension)."""
    return findings.rollup(F.substring("category", 1, 5).alias("class"), "severity").agg(F.count("*").alias("n_findings"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings that only one of two scans has, marked `gone` or `new` (an extension). Each scan is made once: a key with one mark is a difference."""
    keys = ["bundle_id", "path", "line", "category", "severity"]
    both = old.select(*keys, F.lit("gone").alias("change")).unionByName(new.select(*keys, F.lit("new").alias("change")))
    marked = both.groupBy(*keys).agg(F.min("change").alias("change"), F.max("change").alias("__last"))
    return marked.where(F.col("change") == F.col("__last")).drop("__last")
