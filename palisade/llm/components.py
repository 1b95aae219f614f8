"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import stored


def _step(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), all neighbours v of u. Link the larger (or the other) neighbours of u with the least of u and its neighbours."""
    if not large:
        pairs = pairs.where("v < u")
    # Kept as a table: joined with an aggregate of its own, a node's pairs would all stay in one task, however many.
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star-least")
    linked = pairs.join(least, pairs.u == least.k)
    if large:
        got = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        got = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return got.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: two columns of ids. Returns (id, component) for the ids that have links: component is the least id that can be reached.

    Null ids and links from an id to itself are dropped; repeated links count once; an empty table gives an empty
    result. Nothing but two numbers of each round comes to the driver."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _step(both, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = stored(_step(large, False), "star-links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
