"""Reports: one row of JSON, SARIF or HTML text for each bundle, and the whole scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import escape_html, slug
from palisade.operators import detect, findings, threats
from palisade.operators.bundles import bundle_hashes
from palisade.plans import packs
from palisade.session import stored
from palisade.sources import named_files

VERSION = "1.0"


def scan(
    files: DataFrame, known: DataFrame | None = None, extra: DataFrame | dict[str, DataFrame] | None = None, *,
    layers: tuple[str, ...] = ("static",), fail_on: str | None = None, with_calls: bool = True, scan_name: str | None = None,
    rule_packs: tuple[str, ...] = (packs.CORE,),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, findings, new threats): known bundles are answered from the threat table, the others are scanned.

    extra: findings of other layers for the same bundles, by the layer's name ({"llm": ..., "sandbox": ...}). layers: those
    of this library that run; without "static" only extra findings and the threat table count. fail_on: adds `fails`, whether
    a bundle has a finding of at least this severity. rule_packs: "core" and paths of rule files. Results carry an envelope: scan_id (the same for a bundle and
    scan_name, by default a name of its own), scanned_at and layers_run. Findings and hashes are made once and stored."""
    extra = {} if extra is None else extra if isinstance(extra, dict) else {"extra": extra}
    name = scan_name or uuid.uuid4().hex
    hashes = stored(bundle_hashes(files), "scan-hashes", small=True)
    open_files = files if known is None else files.join(threats.unknown_bundles(hashes, known).select("bundle_id"), "bundle_id", "left_semi")
    made = detect.static_findings(open_files, with_calls, packs.load(files.sparkSession, *rule_packs))
    made = made if "static" in layers else made.limit(0)
    for found in extra.values():
        made = made.unionByName(found)
    made = stored(made, "scan-findings", small=True)
    kept = findings.dedupe(made if known is None else made.unionByName(threats.known_findings(hashes, known)))
    results = findings.scores(kept, hashes).join(hashes, "bundle_id")
    if fail_on is not None:
        results = results.join(findings.gate(kept, hashes, fail_on), "bundle_id")
    run = [*(["threat_db"] if known is not None else []), *[x for x in layers if x == "static"], *extra]
    digest = F.md5(F.concat_ws(":", F.lit(name), F.col("bundle_id")))
    scan_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    results = results.select("*", scan_id.alias("scan_id"), F.current_timestamp().alias("scanned_at"), F.array(*map(F.lit, run)).cast("array<string>").alias("layers_run"))
    return results, kept, threats.new_threats(made, hashes)


#: Columns of a result's envelope, where it has them.
ENVELOPE = ("scan_id", "scanned_at", "layers_run", "fails")


def gathered(results: DataFrame, found: DataFrame, item: Column) -> DataFrame:
    """results with `items`: item of each finding of the bundle, in display order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))), lambda s: s["x"])
    rows = findings.ranked(found).groupBy("bundle_id").agg(items.alias("items"))
    return results.join(rows, "bundle_id", "left")


def json_reports(results: DataFrame, found: DataFrame) -> DataFrame:
    item = F.struct("severity", "category", F.col("path").alias("file"), "line", "description", "remediation", "engine", "confidence")
    rows = gathered(results, found, item)
    envelope = [c for c in ENVELOPE if c in results.columns]
    body = F.struct(*envelope, "bundle_id", "hash", "risk_level", "risk_score", F.coalesce("items", F.array()).alias("findings"))
    return rows.select("bundle_id", F.to_json(body, {"pretty": "true"}).alias("report"))


def sarif_reports(results: DataFrame, found: DataFrame) -> DataFrame:
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    message = F.struct(F.col("description").alias("text"))
    rule = F.struct(slug(F.col("category")).alias("id"), F.col("category").alias("name"), message.alias("shortDescription"), F.struct(level.alias("level")).alias("defaultConfiguration"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(slug(F.col("category")).alias("ruleId"), level.alias("level"), message.alias("message"), F.array(place).alias("locations"), F.struct("confidence", "engine", "remediation").alias("properties"))
    rows = gathered(results, found, F.struct(rule.alias("rule"), result.alias("result")))
    part = lambda name: F.coalesce(F.transform("items", lambda x: x[name]), F.array())
    run = F.struct(F.struct(F.struct(F.lit("palisade").alias("name"), F.lit(VERSION).alias("version"), part("rule").alias("rules")).alias("driver")).alias("tool"), part("result").alias("results"))
    return rows.select("bundle_id", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))


def dated(results: DataFrame) -> Column:
    """The date and the layers of a result, as far as it has them."""
    parts = []
    if "scanned_at" in results.columns:
        parts += [F.lit(", "), F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")]
    if "layers_run" in results.columns:
        parts += [F.lit(", layers: "), escape_html(F.array_join("layers_run", ", "))]
    return F.concat(*parts) if parts else F.lit("")


def console_reports(results: DataFrame, found: DataFrame) -> DataFrame:
    """(bundle_id, report): a summary in plain text, the worst findings first."""
    place = F.concat_ws(":", "path", "line")
    item = F.concat(
        F.rpad("severity", 9, " "), "category", F.lit("\n    in "), place, F.lit("\n    "), "description", F.lit("\n    -> "), "remediation",
        F.format_string("\n    found by %s, %.0f%% sure", "engine", F.col("confidence") * 100),
    )
    rows = gathered(results, found, item)
    head = F.format_string("%s: %s, %.1f of 10, %d findings", "bundle_id", "risk_level", "risk_score", "n_findings")
    return rows.select("bundle_id", F.concat_ws("\n", head, F.coalesce(F.array_join("items", "\n"), F.lit("Nothing was found."))).alias("report"))


def html_reports(results: DataFrame, found: DataFrame) -> DataFrame:
    color = F.when(F.col("severity") == "CRITICAL", "#c00").when(F.col("severity") == "HIGH", "#d60").when(F.col("severity") == "MEDIUM", "#a80").otherwise("#666")
    safe = {c: escape_html(F.col(c)) for c in ("category", "description", "remediation")} | {"place": escape_html(F.concat_ws(":", "path", "line"))}
    item = F.concat(
        F.lit('<li style="color:'), color, F.lit('"><b>'), "severity", F.lit("</b> "), safe["category"], F.lit(" <code>"), safe["place"],
        F.lit("</code><p>"), safe["description"], F.lit("</p><p>"), safe["remediation"], F.lit("</p></li>"),
    )
    rows = gathered(results, found, item)
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), escape_html(F.col("bundle_id")), F.lit("</title></head><body><h1>"), "risk_level", F.format_string(" %.1f/10", "risk_score"),
        F.lit("</h1><p>"), F.col("n_findings").cast("string"), F.lit(" findings"), dated(results), F.lit("</p><ul>"), F.coalesce(F.array_join("items", ""), F.lit("")), F.lit("</ul></body></html>"),
    )
    return rows.select("bundle_id", page.alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as Parquet, one row a bundle, by Spark's writer: millions of small files help no one."""
    reports.write.mode("overwrite").parquet(path)


#: File name ends by the kind of report.
ENDS = {"json": json_reports, "sarif": sarif_reports, "html": html_reports, "txt": console_reports}


def write_report_files(results: DataFrame, found: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """A file for each bundle, named by the first 8 signs of its scan_id (by all of it, where bundles share them); results as scan() makes them.

    Files become visible all at once (see named_files.py)."""
    short = F.substring("scan_id", 1, 8)
    shared = F.count("*").over(Window.partitionBy(short))
    names = results.select("bundle_id", F.concat(F.lit("report-"), F.when(shared == 1, short).otherwise(F.col("scan_id")), F.lit(f".{kind}")).alias("name"))
    named_files.write_files(ENDS[kind](results, found).join(names, "bundle_id").select("name", F.col("report").alias("content")), path, mode)
