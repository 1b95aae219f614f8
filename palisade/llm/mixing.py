"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions alone.

Documents are leaves of a tree domain - language - source. A token budget flows from the root to the leaves: each
node's budget is dealt to its children by their weights, and a child that holds less than its share takes all it
has while its siblings share the rest by their weights. A child's supply counts all leaves below it, so a shortage
is made up among siblings as far as they can, and only then among the ancestors' other children. Each leaf then
takes its tokens from seeded epochs: whole passes over its documents, and of the last pass the documents that
begin before the budget ends, in an order seeded by epoch and document. A document is never cut, so a leaf passes
its budget by less than one document.

A hot leaf is not ordered in one task: its documents fall into 4,096 buckets by their seeded order, the buckets'
token sums are added up in order, and only documents within a bucket are sorted.

Defined results: a null or empty text has no tokens and costs nothing; null domains, languages and sources are
nodes of their own, named ''; repeated rows, and rows that share a doc_id, are documents of their own, each taken by
itself; a row without a doc_id is ordered by its text's digest; ties in the order are broken by doc_id and length; nodes without a weight have DEFAULT_WEIGHT; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import shared_path

DEFAULT_WEIGHT = 1
# Target weights of the registered query (whole numbers; only their ratios count).
DOMAIN_WEIGHTS = {"web": 50, "books": 30, "reference": 20}
LANGUAGE_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
SOURCE_WEIGHTS: dict[str, int] = {}
MAX_EPOCHS, BUDGET_PERCENT, SEED = 2, 100, 17
WORDS = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: src0 to src7 are web, src8 to src13 books, all others reference."""
    number = F.regexp_extract(source, "^src([0-9]+)$", 1).try_cast("int")
    return F.when(number <= 7, "web").when(number <= 13, "books").otherwise("reference")


def weight(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(DEFAULT_WEIGHT)
    for key, value in weights.items():
        found = F.when(name == key, value).otherwise(found)
    return found.cast("long")


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, name, weight, cap, budget of the parent) with `share`, a whole number of tokens."""
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("cap") / F.col("weight"), "name")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # A node is short if even its share of what the shorter ones leave exceeds what it holds.
    short = nodes.withColumn("short", F.col("cap") * from_here <= F.col("weight") * (F.col("budget") - before))
    taken = F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(group), F.lit(0))
    left = F.sum(F.when(~F.col("short"), F.col("weight"))).over(group)
    return short.withColumn("taken", taken).withColumn("left", left).withColumn("share", F.when(F.col("short"), F.col("cap")).otherwise(F.expr("weight * (budget - taken) div left"))).drop("short", "taken", "left")


def leaf_budgets(leaves: DataFrame, weights: tuple[dict, dict, dict], percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, supply) to the same with `quota`, level by level."""
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    total = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("root", F.lit(0)).withColumn("budget", F.floor(F.sum("supply").over(total) * percent / 100).cast("long")).drop("supply")
    domains = deal(domains.withColumn("name", F.col("domain")).withColumn("weight", weight(F.col("domain"), weights[0])), ["root"])
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = deal(langs.withColumn("name", F.col("lang")).withColumn("weight", weight(F.col("lang"), weights[1])), ["domain"])
    sources = caps.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    sources = deal(sources.withColumn("name", F.col("source")).withColumn("weight", weight(F.col("source"), weights[2])), ["domain", "lang"])
    return sources.select("domain", "lang", "source", "supply", F.col("share").alias("quota"))


Weights = tuple[dict[str, int], dict[str, int], dict[str, int]]
KEYS = ["domain", "lang", "source"]


def leaves_of(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, name) and `more`; name seeds a document's order: its doc_id or else its text's digest."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", domain_of(named("source")).alias("domain"), named("lang").alias("lang"), named("source").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)).alias("name"), *more,
    )


def take(
    docs: DataFrame, more: tuple[Column, ...], weights: Weights = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS),
    percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """leaves_of(docs, *more) with `copies`, how many epochs take the row. Budgets and bucket sums come from a narrow
    table that is written once; rows themselves are shuffled once, to be sorted within their buckets."""
    narrow = shared_path(docs.sparkSession, "mixing-leaves")
    leaves_of(docs).write.parquet(narrow)
    known = docs.sparkSession.read.parquet(narrow)
    quotas = leaf_budgets(known.groupBy(*KEYS).agg(F.sum("n_tokens").alias("supply")), weights, percent, max_epochs)
    full = F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(0)
    quotas = quotas.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("supply"))
    # A leaf's order is that of the epoch it takes in part; leaves that use up every epoch have none, and take all rows.
    path = shared_path(docs.sparkSession, "mixing-quotas")
    quotas.select(*KEYS, "full", "rest").write.parquet(path)
    quotas = docs.sparkSession.read.parquet(path)

    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("full"), F.col("name")))
    ordered = lambda rows: rows.join(quotas, KEYS).withColumn("order", order).withColumn("bucket", F.substring("order", 1, 3))
    sums = ordered(known).groupBy(*KEYS, "bucket").agg(F.sum("n_tokens").alias("size"))
    running = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select(*KEYS, "bucket", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*KEYS, "bucket").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = ordered(leaves_of(docs, *more)).join(buckets, [*KEYS, "bucket"]).withColumn("start", start)
    part = (F.col("full") < max_epochs) & (F.col("start") < F.col("rest"))
    return placed.withColumn("copies", (F.col("full") + F.when(part, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of each document: copies is how many epochs take it, 0 for none."""
    return take(docs, (), **options).select("doc_id", *KEYS, "n_tokens", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that are chosen, each row as often as it is taken, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    picked = take(docs, (row,), **options).where("copies > 0")
    return picked.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: DuckDB SQL for mix() with the registered query's parameters.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id,
         CASE WHEN n <= 7 THEN 'web' WHEN n <= 13 THEN 'books' ELSE 'reference' END AS domain, lang, source, n_tokens, name
  FROM (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]+)$', 1) AS INT) AS n,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
        FROM documents)),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) AS BIGINT) * 2 AS cap FROM d GROUP BY ALL),
dom0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(supply) AS BIGINT) FROM leaves) AS budget,
                CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 30 WHEN 'reference' THEN 20 ELSE 1 END AS weight FROM leaves GROUP BY domain),
dom1 AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                   <= weight * (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS short FROM dom0),
dom AS (SELECT domain, CASE WHEN short THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (WHERE short) OVER (), 0)) // sum(weight) FILTER (WHERE NOT short) OVER () END AS share FROM dom1),
lan0 AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(dom.share) AS budget,
                CASE l.lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 1 END AS weight FROM leaves l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
lan1 AS (SELECT *, cap * sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                   <= weight * (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS short FROM lan0),
lan AS (SELECT domain, lang, CASE WHEN short THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (WHERE short) OVER (PARTITION BY domain), 0)) // sum(weight) FILTER (WHERE NOT short) OVER (PARTITION BY domain) END AS share FROM lan1),
src0 AS (SELECT l.*, lan.share AS budget, 1 AS weight FROM leaves l JOIN lan USING (domain, lang)),
src1 AS (SELECT *, cap * sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                   <= weight * (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS short FROM src0),
src AS (SELECT domain, lang, source, supply, CASE WHEN short THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (WHERE short) OVER (PARTITION BY domain, lang), 0)) // sum(weight) FILTER (WHERE NOT short) OVER (PARTITION BY domain, lang) END AS quota FROM src1),
q AS (SELECT *, CASE WHEN supply > 0 THEN quota // supply ELSE 0 END AS f FROM src),
o AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.n_tokens, q.f, q.quota - q.f * q.supply AS rest,
             coalesce(sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17:' || CAST(q.f AS VARCHAR) || ':' || d.name), d.doc_id, d.n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(f + CASE WHEN f < 2 AND before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o
"""
