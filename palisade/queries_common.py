"""What the modules of registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
FOUND = ("bundle_id", "path", "line", "severity", "category", "engine", "confidence")
FOUND_COLUMNS = "bundle_id, path, CAST(line AS BIGINT) AS line, severity, category, engine, round(CAST(confidence AS DOUBLE), 6) AS confidence"


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def shown(rows: DataFrame) -> DataFrame:
    """Findings without their texts, which are wording and not results."""
    return rows.select(*[F.col(c).cast("long").alias(c) if c == "line" else F.round(c, 6).alias(c) if c == "confidence" else F.col(c) for c in FOUND])
