"""Registered queries of the scanning operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import intake_queries
from palisade.functions.text import fold_ascii
from palisade.operators import bundles, detect, findings, model_layer, reports, threats
from palisade.operators import scan_all as scan_folders
from palisade.operators.threat_store import ThreatStore
from palisade.plans import intake, packs, programs
from palisade.plans.planted import files_sql, planted_files, tree_files, tree_sql
from palisade.plans.rules import RULES, Rule, condition, rules_table, sql_condition, sql_string
from palisade.session import shared_path, stored
from palisade.queries_common import FOUND_COLUMNS as _FOUND_COLUMNS
from palisade.queries_common import Query, shown
from palisade.queries_common import longs as _long
from palisade.sources import router
from palisade.streaming import watch

# ---- intake ----

def url_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", router.file_name_of(F.col("url")).alias("file_name"))


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_files(spark, sf_dir).select("bundle_id", "path", detect.is_text_file(F.col("path")).alias("is_text"))


def script_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.scripts(planted_files(spark, sf_dir))


def marker_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.marked_folders(planted_files(spark, sf_dir)).select("bundle_id", "folder", *_long("n_markers"))


def bundle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.bundle_hashes(planted_files(spark, sf_dir))


def bundle_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.text_digests(planted_files(spark, sf_dir))


# ---- detectors ----


def sig_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = detect.signature_hits(planted_files(spark, sf_dir))
    return hits.join(F.broadcast(rules_table(spark)), "rule_ord").select("bundle_id", "path", "rule_id", "category", "severity")


#: Rules of the large pack beside the built-in ones.
MANY_RULES = 243


def pack_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in rules and a large pack, written as a rule file, read and scanned for."""
    path = shared_path(spark, "pack")
    spark.createDataFrame([(packs.written([*RULES, *packs.many(MANY_RULES)]),)], "value string").coalesce(1).write.text(path, lineSep="\n")
    rules = packs.load(spark, path)
    hits = detect.signature_hits(planted_files(spark, sf_dir), rules)
    return hits.join(F.broadcast(rules_table(spark, rules)), "rule_ord").select("bundle_id", "path", "rule_id", "category", "severity")


def _sig(number: int) -> Query:
    prefix = f"SD{number:02d}_"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sig_all(spark, sf_dir).where(F.col("rule_id").startswith(prefix))

    return run


def rules_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, with the number of files that each matches."""
    hits = detect.signature_hits(planted_files(spark, sf_dir)).groupBy("rule_ord").agg(F.count("*").alias("n_files"))
    rows = F.broadcast(rules_table(spark)).join(hits, "rule_ord", "left")
    return rows.select(*_long("rule_ord"), "rule_id", "category", "severity", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def url_network_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in RULES if r.rule_id == "SD03_Network_Exfiltration")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", fold_ascii(F.col("url")).alias("lo"))
    return rows.where(condition(rule, F.col("lo"), F.col("url"))).select("page_id", "url")


def entropy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.entropy_chunks(planted_files(spark, sf_dir)).select("bundle_id", "path", *_long("chunk"), F.round("entropy", 6).alias("entropy"))


def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.entropy_findings(planted_files(spark, sf_dir)))


def zero_width_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.marked_lines(planted_files(spark, sf_dir)).where("zero_width > 0").select("bundle_id", "path", *_long("line", "zero_width"))


def rtl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.marked_lines(planted_files(spark, sf_dir)).where("rtl").select("bundle_id", "path", *_long("line"))


def py_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.call_sites(planted_files(spark, sf_dir)).select("bundle_id", "path", *_long("seq", "line"), "callee")


def py_call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.call_findings(planted_files(spark, sf_dir)))


def py_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a generated program for each document, with broken lines in it."""
    return detect.call_sites(programs.programs(spark, sf_dir)).select("bundle_id", "path", *_long("seq", "line"), "callee")


# ---- verdicts ----


def _static(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = planted_files(spark, sf_dir)
    return detect.static_findings(files), files.select("bundle_id").distinct()


def static_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_static(spark, sf_dir)[0])


def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(findings.dedupe(_static(spark, sf_dir)[0]))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, all_bundles = _static(spark, sf_dir)
    return findings.scores(findings.dedupe(made), all_bundles).select("bundle_id", *_long("n_findings"), F.round("risk_score", 6).alias("risk_score"), "risk_level")


def fail_on_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, all_bundles = _static(spark, sf_dir)
    return findings.gate(findings.dedupe(made), all_bundles, "critical")


def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _static(spark, sf_dir)
    rows = findings.ranked(findings.dedupe(made))
    return rows.select("bundle_id", *_long("rank"), "path", "severity", "category", F.round("confidence", 6).alias("confidence"))


def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.engine_counts(_static(spark, sf_dir)[0]).select("bundle_id", "engine", *_long("n_findings"))


def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.class_rollup(_static(spark, sf_dir)[0]).select("class", "severity", *_long("n_findings"))


def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a scan of all of them from before the rules' payloads (slots 0 to 26) were planted: what these
    add and take away. The other payloads stand in both scans."""
    made, _ = _static(spark, sf_dir)
    earlier = planted_files(spark, sf_dir, before=range(27))
    return findings.diff(detect.static_findings(earlier), made).select("bundle_id", "path", *_long("line"), "category", "severity", "change")


def diff_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of all documents, the earlier one with the rules' payloads (slots 0 to 26), the later one with the others: both gone and new."""
    earlier, later = (planted_files(spark, sf_dir, before=slots) for slots in (range(27, 61), range(27)))
    return findings.diff(detect.static_findings(earlier), detect.static_findings(later)).select("bundle_id", "path", *_long("line"), "category", "severity", "change")


# ---- threat table ----


def _threats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, hashes, a threat table that knows the bundles of three sources)."""
    files = planted_files(spark, sf_dir)
    hashes = stored(bundles.bundle_hashes(files), "threat-hashes", small=True)
    known = hashes.where(F.col("bundle_id").rlike("^src(1|2|3)-")).select(
        "hash", F.lit("SD-02 · Command Injection").alias("category"), F.when(F.col("bundle_id").startswith("src3-"), "odd").otherwise("critical").alias("severity"), F.lit("seen before").alias("description"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("added_at"),
    )
    return files, hashes, known


def threat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hashes, known = _threats(spark, sf_dir)
    return shown(threats.known_findings(hashes, known))


def threat_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hashes, known = _threats(spark, sf_dir)
    return threats.unknown_bundles(hashes, known)


def threat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, hashes, known = _threats(spark, sf_dir)
    new = threats.new_threats(detect.static_findings(files), hashes)
    return threats.merged(known, new).select("hash", "category", "severity")


def threat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threats.stats(_threats(spark, sf_dir)[2]).select(*_long("n_threats"))


# ---- model layer, telemetry ----


def llm_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted_files(spark, sf_dir)
    rows = model_layer.prompts(bundles.bundle_heads(files, model_layer.PROMPT_BYTES), detect.static_findings(files))
    return rows.select("bundle_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.octet_length("prompt").cast("long").alias("n_bytes"))


# ---- reports, stream ----


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the JSON reports list, read back from their text; a bundle without any has one row."""
    results, found, _ = reports.scan(planted_files(spark, sf_dir))
    item = "array<struct<severity: string, category: string, file: string, line: long, engine: string, confidence: double>>"
    r = F.from_json("report", f"bundle_id string, hash string, risk_level string, risk_score double, findings {item}")
    rows = reports.json_reports(results, found).select(r.alias("r")).select("r.*", F.posexplode_outer("r.findings").alias("place", "f"))
    rows = rows.select("bundle_id", "hash", "risk_level", F.round("risk_score", 6).alias("risk_score"), *_long("place"), "f.*")
    return rows.withColumn("confidence", F.round("confidence", 6))


def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results that the SARIF reports list, each with its rule, read back from their text."""
    results, found, _ = reports.scan(planted_files(spark, sf_dir))
    place = "array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: long>>>>"
    result = f"array<struct<ruleId: string, level: string, locations: {place}, properties: struct<confidence: double, engine: string>>>"
    rule = "array<struct<id: string, name: string, defaultConfiguration: struct<level: string>>>"
    r = F.from_json("report", f"version string, runs array<struct<tool: struct<driver: struct<rules: {rule}>>, results: {result}>>")
    run = reports.sarif_reports(results, found).select("bundle_id", r.alias("r")).select("bundle_id", "r.version", F.get("r.runs", F.lit(0)).alias("run"))
    both = F.arrays_zip(F.col("run.results").alias("result"), F.col("run.tool.driver.rules").alias("rule"))
    rows = run.select("bundle_id", "version", F.posexplode(both).alias("place", "x"))
    at = F.get("x.result.locations", F.lit(0))["physicalLocation"]
    return rows.select(
        "bundle_id", "version", *_long("place"), F.col("x.rule.id").alias("rule_id"), F.col("x.rule.name").alias("rule_name"), F.col("x.rule.defaultConfiguration.level").alias("rule_level"), F.col("x.result.ruleId").alias("result_rule"),
        F.col("x.result.level").alias("level"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), F.round("x.result.properties.confidence", 6).alias("confidence"), F.col("x.result.properties.engine").alias("engine"),
    )


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the HTML reports show: title, level and score, findings by colour, and the files that they name, read back from their text."""
    results, found, _ = reports.scan(planted_files(spark, sf_dir))
    part = lambda pattern: F.regexp_extract("report", pattern, 1)
    count = lambda text: F.regexp_count("report", F.lit(text)).cast("long")
    rows = reports.html_reports(results, found)
    return rows.select(
        "bundle_id", part("<title>(.*?)</title>").alias("title"), part("<h1>(.*?)</h1>").alias("head"), part("</h1><p>([0-9]+) findings, ").cast("long").alias("n_findings"), part("layers: ([a-z_, ]*)</p>").alias("layers"),
        count('<li style="color:#c00">').alias("n_critical"), count('<li style="color:#d60">').alias("n_high"), count('<li style="color:#a80">').alias("n_medium"),
        F.array_join(F.regexp_extract_all("report", F.lit("<code>(.*?)</code>"), F.lit(1)), " ").alias("places"),
    )


def scan_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: known bundles from the threat table, the others by all static detectors."""
    files, _, known = _threats(spark, sf_dir)
    results, _, _ = reports.scan(files, known)
    return results.select("bundle_id", "hash", *_long("n_findings"), F.round("risk_score", 6).alias("risk_score"), "risk_level")


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of all folders with a marker, nested ones included."""
    results, _, _ = scan_folders.scan_all(tree_files(spark, sf_dir))
    return results.select("bundle_id", "folder", *_long("n_scans", "n_files", "n_findings"), "hash", F.round("risk_score", 6).alias("risk_score"), "risk_level")


def report_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain summaries; their first lines and lengths in lines are compared with SQL."""
    results, found, _ = reports.scan(planted_files(spark, sf_dir))
    rows = reports.console_reports(results, found)
    return rows.select("bundle_id", F.substring_index("report", "\n", 1).alias("head"), F.regexp_count("report", F.lit("found by ")).cast("long").alias("n_shown"))


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests of all bundles: their shape, and the digest of the prompt that they carry."""
    files = planted_files(spark, sf_dir)
    asked = model_layer.prompts(bundles.bundle_heads(files, model_layer.PROMPT_BYTES), detect.static_findings(files))
    get = lambda path: F.get_json_object("request", path)
    rows = model_layer.requests(asked, "some-model")
    return rows.select("bundle_id", get("$.model").alias("model"), get("$.messages[0].role").alias("first_role"), get("$.messages[1].role").alias("second_role"), get("$.response_format.type").alias("answer"), get("$.temperature").alias("temperature"), F.sha2(get("$.messages[1].content"), 256).alias("prompt_sha256"))


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, scanned as far as it has come."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    docs = watch.stream_table(spark, sf_dir, "documents.parquet", schema)
    files = docs.select(F.col("source").alias("bundle_id"), F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", "text", F.when(F.col("doc_id") % 61 == 9, "a permission for the admin")).alias("text"), F.current_timestamp().alias("seen"))
    files = watch.fresh(files.withColumn("content", F.col("text").cast("binary")))
    out, marks = shared_path(spark, "stream-out"), shared_path(spark, "stream-marks")
    watch.finished(watch.scan_stream(files, out, marks))
    return shown(spark.read.parquet(out).drop("batch"))


def stream_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops of the same bundles, the second under other names, scanned as a stream: what the first shows answers the second."""
    drop, out, marks, table = (shared_path(spark, f"stream-{x}") for x in ("drop", "results", "progress", "threats"))
    files, store = planted_files(spark, sf_dir).select("bundle_id", "path", "text", "content"), ThreatStore(spark, table)
    for prefix in ("", "again-"):
        files.withColumn("bundle_id", F.concat(F.lit(prefix), "bundle_id")).write.mode("append").parquet(drop)
        watch.finished(watch.scan_bundles(spark.readStream.schema(files.schema).parquet(drop), store, out, marks))
    by_bundle = spark.read.parquet(f"{out}/findings").groupBy("batch", "bundle_id").agg(F.bool_or(F.col("engine") == "threat_db").alias("answered"))
    rows = spark.read.parquet(f"{out}/results").join(by_bundle, ["batch", "bundle_id"], "left")
    return rows.select(*_long("batch"), "bundle_id", *_long("n_findings"), F.round("risk_score", 6).alias("risk_score"), "risk_level", F.coalesce("answered", F.lit(False)).alias("answered"))


def threat_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored threat table after two upserts, the known bundles and then a scan's threats, read back version by version."""
    files, hashes, known = _threats(spark, sf_dir)
    store = ThreatStore(spark, shared_path(spark, "threats"))
    store.upsert(known)
    store.upsert(threats.new_threats(detect.static_findings(files), hashes))
    rows = [store.read(v).select(F.lit(v).cast("long").alias("version"), "hash", "category", "severity") for v in (1, 2)]
    return rows[0].unionByName(rows[1])


def queries() -> dict[str, Query]:
    named = [
        url_file_names, text_filter, script_discovery, marker_discovery, bundle_hash, bundle_concat, sig_all, pack_hits, rules_list, url_network_hits, entropy_chunks, entropy_findings, zero_width_lines, rtl_lines,
        py_calls, py_programs, py_call_findings, static_findings, dedupe_findings, risk_scores, fail_on_gate, findings_ranked, engine_counts, class_rollup, diff_findings, diff_both, threat_lookup, threat_short_circuit, threat_upsert,
        threat_stats, llm_prompt, scan_bundles, scan_all, report_console, model_requests, report_json, report_sarif, report_html, stream_scan, stream_threats, threat_versions,
    ]
    out = {q.__name__: q for q in named} | {f"sig_sd{i:02d}": _sig(i) for i in range(1, 11)}
    return out | intake_queries.queries()


# ---- SQL ----

_BASE = "string_split(path, '/')[-1]"
_EXT = f"regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)"
_IS_TEXT = f"({_EXT} IN ({', '.join(map(sql_string, detect.TEXT_EXTENSIONS))}) OR {_BASE} IN ({', '.join(map(sql_string, detect.TEXT_NAMES))}))"
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.0 WHEN 'MEDIUM' THEN 4.0 WHEN 'LOW' THEN 1.0 ELSE 0.0 END"
_ORDER = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_MADE = "layer_ord, string_split(path, '/'), n"
# The calls of the planted programs: (slot, seq, line, callee).
_CALLS = [(38, 0, 2, "subprocess.run"), (38, 1, 2, "eval"), (38, 2, 3, "os.system"), (39, 0, 2, "ast.literal_eval"), (39, 1, 3, "os.environ.get"), (40, 0, 2, "os.popen"), (40, 1, 3, "requests.get"), (46, 0, 1, "print")]


def _with(*ctes: str, body: str, files: str | None = None) -> str:
    return "WITH " + ",\n".join([files or files_sql(), *ctes]) + "\n" + body


def _scan_all_sql(static: list[str], kept: str, scored: str) -> str:
    """scans: each marked folder with the files below it; the parts of a single scan follow with (bundle, folder) as their key."""
    key = "{'b': f.bundle_id, 'd': s.folder}"
    below = f"JOIN scans s ON f.bundle_id = s.bundle_id AND (s.folder = '' OR starts_with(f.path, s.folder || '/'))"
    rest = "CASE WHEN s.folder = '' THEN f.path ELSE substr(f.path, CAST(length(s.folder) + 2 AS BIGINT)) END"
    return _with(
        f"marked AS (SELECT bundle_id, regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS n_scans FROM files WHERE {_BASE} IN ('SKILL.md', '.clauderules', '.cursorrules') GROUP BY ALL)",
        "scans AS (SELECT bundle_id, folder FROM marked)",
        *static,
        f"joined AS (SELECT {key} AS bundle_id, {rest} AS path, line, severity, category, engine, confidence, layer_ord, n FROM found f {below})",
        kept.replace("FROM found", "FROM joined"),
        f"parts AS (SELECT {key} AS bundle_id, {rest} AS path, text FROM files f {below})",
        "hashes AS (SELECT bundle_id, count(*) AS n_files, sha256(string_agg(text, '' ORDER BY string_split(path, '/'))) AS hash FROM parts GROUP BY bundle_id)",
        scored.replace("FROM files", "FROM parts"),
        body=f"""SELECT m.bundle_id, m.folder, CAST(n_scans AS BIGINT) AS n_scans, CAST(n_files AS BIGINT) AS n_files, CAST(n_findings AS BIGINT) AS n_findings, hash,
            round(CAST(risk_score AS DOUBLE), 6) AS risk_score, {_LEVEL} FROM scored x JOIN hashes h ON x.bundle_id = h.bundle_id JOIN marked m ON {{'b': m.bundle_id, 'd': m.folder}} = x.bundle_id""",
        files=tree_sql(),
    )


def _hits_sql(rules: list[Rule]) -> str:
    one = "SELECT bundle_id, path, {i} AS rule_ord, {id} AS rule_id, {category} AS category, {severity} AS severity FROM texts WHERE {test}"
    return "\nUNION ALL ".join(one.format(i=i, id=sql_string(r.rule_id), category=sql_string(r.category), severity=sql_string(r.severity), test=sql_condition(r)) for i, r in enumerate(rules))


def _sql_parts() -> dict[str, str]:
    zero, rtl = sql_string("[​‌‍﻿]"), sql_string("‮")
    hits = _hits_sql(RULES)
    calls = ", ".join(f"({a}, {b}, {c}, {sql_string(d)})" for a, b, c, d in _CALLS)
    table = ", ".join(f"({i}, {sql_string(p)}, {sql_string(s)}, {sql_string(c)}, {conf}, {str(start).lower()})" for i, ((p, s, c, _), conf, start) in enumerate([(r, 0.9, False) for r in detect.CALLS] + [(r, 0.8, True) for r in detect.ATTRIBUTES]))
    return {
        "texts": f"texts AS (SELECT * FROM files WHERE {_IS_TEXT})",
        "hits": f"hits AS ({hits})",
        "bytes": """bytes AS (SELECT bundle_id, path, chunk, substr(part, CAST(2 * i + 1 AS BIGINT), 2) AS b
            FROM (SELECT *, unnest(range(length(part) // 2)) AS i
            FROM (SELECT bundle_id, path, chunk, substr(h, CAST(2048 * chunk + 1 AS BIGINT), 2048) AS part
            FROM (SELECT bundle_id, path, h, unnest(range((length(h) + 2047) // 2048)) AS chunk FROM (SELECT bundle_id, path, hex(encode(text)) AS h FROM texts)))))""",
        "chunks": """chunks AS (SELECT bundle_id, path, chunk, -sum(c / total * log2(c / total)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY bundle_id, path, chunk) AS total
            FROM (SELECT bundle_id, path, chunk, b, CAST(count(*) AS DOUBLE) AS c FROM bytes GROUP BY ALL)) WHERE total >= 64 GROUP BY bundle_id, path, chunk)""",
        "marks": f"""marks AS (SELECT bundle_id, path, pos AS line, len(regexp_extract_all(l, {zero})) AS zero_width, contains(l, {rtl}) AS rtl
            FROM (SELECT bundle_id, path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT bundle_id, path, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM (SELECT bundle_id, path, regexp_split_to_array(text, '\\r?\\n') AS parts FROM texts WHERE regexp_matches(text, {sql_string('[​‌‍﻿‮]')})))))""",
        "sites": f"calls(slot, seq, line, callee) AS (VALUES {calls}), sites AS (SELECT bundle_id, path, seq, line, callee FROM files JOIN calls ON doc_id % 61 = slot)",
        "called": f"""calltable(pos, pattern, severity, category, confidence, is_start) AS (VALUES {table}),
            called AS (SELECT bundle_id, path, line, severity, category, 'ast' AS engine, confidence, 3 AS layer_ord, seq * 100 + pos AS n FROM sites JOIN calltable ON CASE WHEN is_start THEN starts_with(callee, pattern) ELSE ends_with(callee, pattern) END)""",
        "found": """found AS (
            SELECT bundle_id, path, CAST(NULL AS BIGINT) AS line, severity, category, 'yara' AS engine, CAST(0.85 AS DOUBLE) AS confidence, 0 AS layer_ord, rule_ord AS n FROM hits
            UNION ALL SELECT bundle_id, path, NULL, 'MEDIUM', 'SD-10 · Obfuscation and Evasion', 'entropy', 0.7, 1, 0 FROM chunks WHERE entropy > 5.5 GROUP BY bundle_id, path
            UNION ALL SELECT bundle_id, path, line, 'HIGH', 'SD-01 · Prompt Injection (ASCII Smuggling)', 'unicode', 0.9, 2, line * 2 FROM marks WHERE zero_width > 0
            UNION ALL SELECT bundle_id, path, line, 'MEDIUM', 'SD-10 · Obfuscation and Evasion', 'unicode', 0.6, 2, line * 2 + 1 FROM marks WHERE rtl
            UNION ALL SELECT bundle_id, path, line, severity, category, engine, confidence, layer_ord, n FROM called)""",
        "kept": f"kept AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY bundle_id, category, path, line ORDER BY confidence DESC, {_MADE}) = 1)",
        "scored": f"""scored AS (SELECT b.bundle_id, coalesce(n, 0) AS n_findings, CASE WHEN base IS NULL THEN 0.0 ELSE least(10.0, least(10.0, base) + bonus) END AS risk_score, worst
            FROM (SELECT DISTINCT bundle_id FROM files) b LEFT JOIN (SELECT bundle_id, sum(n) AS n, sum(base) AS base, sum((n - 1) * 0.5) AS bonus, max(worst) AS worst
              FROM (SELECT bundle_id, engine, count(*) AS n, sum(CAST({_WEIGHT} AS DOUBLE) * confidence) AS base, max({_ORDER}) AS worst FROM kept GROUP BY ALL) GROUP BY bundle_id) s USING (bundle_id))""",
        "hashes": "hashes AS (SELECT bundle_id, sha256(string_agg(text, '' ORDER BY string_split(path, '/'))) AS hash FROM files GROUP BY bundle_id)",
        "bodies": "bodies AS (SELECT bundle_id, string_agg('=== ' || path || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY string_split(path, '/')) AS body FROM files GROUP BY bundle_id)",
        "known": "known AS (SELECT hash, 'SD-02 · Command Injection' AS category, CASE WHEN starts_with(bundle_id, 'src3-') THEN 'odd' ELSE 'critical' END AS severity FROM hashes WHERE regexp_matches(bundle_id, '^src(1|2|3)-'))",
    }


_LEVEL = "CASE WHEN worst = 4 THEN 'DANGEROUS' WHEN worst = 3 THEN 'CAUTION' WHEN risk_score >= 7 THEN 'DANGEROUS' WHEN risk_score >= 4 THEN 'CAUTION' ELSE 'SAFE' END AS risk_level"


def oracle_sql() -> dict[str, str]:
    p = _sql_parts()
    static = [p[k] for k in ("texts", "hits", "bytes", "chunks", "marks", "sites", "called", "found")]
    kept = [*static, p["kept"]]
    sig = "SELECT bundle_id, path, rule_id, category, severity FROM hits"
    rule = next(r for r in RULES if r.rule_id == "SD03_Network_Exfiltration")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    new = f"SELECT hash, category, severity FROM found JOIN hashes USING (bundle_id) WHERE severity IN ('CRITICAL', 'HIGH') QUALIFY row_number() OVER (PARTITION BY hash ORDER BY bundle_id DESC, layer_ord DESC, string_split(path, '/') DESC, n DESC) = 1"
    known_found = "SELECT bundle_id, 'bundle' AS path, CAST(NULL AS BIGINT) AS line, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN upper(severity) ELSE 'INFO' END AS severity, category, 'threat_db' AS engine, CAST(1.0 AS DOUBLE) AS confidence FROM hashes JOIN known USING (hash)"
    rules = ", ".join(f"({i}, {sql_string(r.rule_id)}, {sql_string(r.category)}, {sql_string(r.severity)})" for i, r in enumerate(RULES))
    out = {
        "url_file_names": "SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), ''), 'downloaded_skill.txt') AS file_name FROM pages",
        "text_filter": _with(body=f"SELECT bundle_id, path, {_IS_TEXT} AS is_text FROM files"),
        "script_discovery": _with(body=f"SELECT bundle_id, path, CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'sh' THEN 'shell' ELSE 'node' END AS runtime FROM files WHERE {_EXT} IN ('py', 'js', 'mjs', 'cjs', 'sh') AND len(string_split(path, '/')) <= 4"),
        "marker_discovery": _with(body=f"SELECT bundle_id, regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS n_markers FROM files WHERE {_BASE} IN ('SKILL.md', '.clauderules', '.cursorrules') GROUP BY ALL"),
        "bundle_hash": _with(p["hashes"], body="SELECT * FROM hashes"),
        "bundle_concat": _with(p["bodies"], body="SELECT bundle_id, sha256(body) AS body_sha256, CAST(length(body) AS BIGINT) AS n_chars FROM bodies"),
        "sig_all": _with(p["texts"], p["hits"], body=sig),
        "pack_hits": _with(p["texts"], f"hits AS ({_hits_sql([*RULES, *packs.many(MANY_RULES)])})", body=sig),
        "rules_list": _with(p["texts"], p["hits"], body=f"SELECT CAST(a AS BIGINT) AS rule_ord, b AS rule_id, c AS category, d AS severity, (SELECT count(*) FROM hits WHERE rule_ord = a) AS n_files FROM (VALUES {rules}) v(a, b, c, d)"),
        "url_network_hits": f"SELECT page_id, url FROM (SELECT *, translate(url, '{upper}', '{lower}') AS lo FROM pages) WHERE {sql_condition(rule, 'lo', 'url')}",
        "entropy_chunks": _with(p["texts"], p["bytes"], p["chunks"], body="SELECT bundle_id, path, CAST(chunk AS BIGINT) AS chunk, round(entropy, 6) AS entropy FROM chunks"),
        "entropy_findings": _with(*static, body=f"SELECT {_FOUND_COLUMNS} FROM found WHERE engine = 'entropy'"),
        "zero_width_lines": _with(p["texts"], p["marks"], body="SELECT bundle_id, path, CAST(line AS BIGINT) AS line, CAST(zero_width AS BIGINT) AS zero_width FROM marks WHERE zero_width > 0"),
        "rtl_lines": _with(p["texts"], p["marks"], body="SELECT bundle_id, path, CAST(line AS BIGINT) AS line FROM marks WHERE rtl"),
        "py_calls": _with(p["sites"], body="SELECT bundle_id, path, CAST(seq AS BIGINT) AS seq, CAST(line AS BIGINT) AS line, callee FROM sites"),
        "py_programs": f"WITH {programs.calls_sql()} SELECT bundle_id, path, CAST(seq AS BIGINT) AS seq, CAST(line AS BIGINT) AS line, callee FROM sites",
        "py_call_findings": _with(p["sites"], p["called"], body=f"SELECT {_FOUND_COLUMNS} FROM called"),
        "static_findings": _with(*static, body=f"SELECT {_FOUND_COLUMNS} FROM found"),
        "dedupe_findings": _with(*kept, body=f"SELECT {_FOUND_COLUMNS} FROM kept"),
        "risk_scores": _with(*kept, p["scored"], body=f"SELECT bundle_id, CAST(n_findings AS BIGINT) AS n_findings, round(CAST(risk_score AS DOUBLE), 6) AS risk_score, {_LEVEL} FROM scored"),
        "fail_on_gate": _with(*kept, body=f"SELECT b.bundle_id, coalesce(f.fails, false) AS fails FROM (SELECT DISTINCT bundle_id FROM files) b LEFT JOIN (SELECT bundle_id, bool_or({_ORDER} >= 4) AS fails FROM kept GROUP BY bundle_id) f USING (bundle_id)"),
        "findings_ranked": _with(*kept, body=f"SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY {_ORDER} DESC, confidence DESC, {_MADE}) AS rank, path, severity, category, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM kept"),
        "engine_counts": _with(*static, body="SELECT bundle_id, engine, count(*) AS n_findings FROM found GROUP BY ALL"),
        "class_rollup": _with(*static, body="SELECT substr(category, 1, 5) AS class, severity, count(*) AS n_findings FROM found GROUP BY ROLLUP (substr(category, 1, 5), severity)"),
        "diff_findings": _with(*static, body="SELECT DISTINCT found.bundle_id, found.path, CAST(line AS BIGINT) AS line, category, severity, 'new' AS change FROM found JOIN files USING (bundle_id, path) WHERE doc_id % 61 <= 26"),
        "diff_both": _with(*static, body="""SELECT DISTINCT found.bundle_id, found.path, CAST(line AS BIGINT) AS line, category, severity, CASE WHEN doc_id % 61 <= 26 THEN 'gone' ELSE 'new' END AS change
            FROM found JOIN files USING (bundle_id, path)"""),
        "threat_lookup": _with(p["hashes"], p["known"], body=known_found),
        "threat_short_circuit": _with(p["hashes"], p["known"], body="SELECT bundle_id, hash FROM hashes WHERE hash NOT IN (SELECT hash FROM known)"),
        "threat_upsert": _with(*static, p["hashes"], p["known"], f"fresh AS ({new})", body="SELECT hash, category, severity FROM known WHERE hash NOT IN (SELECT hash FROM fresh) UNION ALL SELECT * FROM fresh"),
        "scan_bundles": _with(
            *static, p["hashes"], p["known"],
            f"answered AS (SELECT bundle_id, path, line, severity, category, engine, confidence, 0 AS layer_ord, 0 AS n FROM ({known_found}))",
            "joined AS (SELECT bundle_id, path, line, severity, category, engine, confidence, layer_ord, n FROM found WHERE bundle_id NOT IN (SELECT bundle_id FROM answered) UNION ALL SELECT * FROM answered)",
            p["kept"].replace("FROM found", "FROM joined"), p["scored"],
            body=f"SELECT bundle_id, hash, CAST(n_findings AS BIGINT) AS n_findings, round(CAST(risk_score AS DOUBLE), 6) AS risk_score, {_LEVEL} FROM scored JOIN hashes USING (bundle_id)",
        ),
        "report_console": _with(*kept, p["scored"], body=f"SELECT bundle_id, printf('%s: %s, %.1f of 10, %d findings', bundle_id, risk_level, risk_score, n_findings) AS head, CAST(n_findings AS BIGINT) AS n_shown FROM (SELECT bundle_id, CAST(n_findings AS BIGINT) AS n_findings, CAST(risk_score AS DOUBLE) AS risk_score, {_LEVEL} FROM scored)"),
        "threat_versions": _with(
            *static, p["hashes"], p["known"], f"fresh AS ({new})",
            body="SELECT CAST(1 AS BIGINT) AS version, hash, category, severity FROM known UNION ALL SELECT 2, hash, category, severity FROM known WHERE hash NOT IN (SELECT hash FROM fresh) UNION ALL SELECT 2, hash, category, severity FROM fresh",
        ),
        "stream_threats": _with(
            *kept, p["scored"], p["hashes"], f"fresh AS ({new})",
            f"once AS (SELECT bundle_id, CAST(n_findings AS BIGINT) AS n_findings, round(CAST(risk_score AS DOUBLE), 6) AS risk_score, {_LEVEL} FROM scored)",
            "twice AS (SELECT bundle_id, severity FROM hashes LEFT JOIN fresh USING (hash))",
            body="""SELECT CAST(0 AS BIGINT) AS batch, *, false AS answered FROM once
            UNION ALL SELECT 1, 'again-' || bundle_id, CASE WHEN severity IS NULL THEN n_findings ELSE 1 END, CASE severity WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.0 ELSE risk_score END,
              CASE severity WHEN 'CRITICAL' THEN 'DANGEROUS' WHEN 'HIGH' THEN 'CAUTION' ELSE risk_level END, severity IS NOT NULL FROM once JOIN twice USING (bundle_id)""",
        ),
        "stream_scan": _with(
            *static, body=f"SELECT {_FOUND_COLUMNS} FROM found",
            files=f"""files AS MATERIALIZED (SELECT *, translate(text, '{upper}', '{lower}') AS lo FROM (SELECT source AS bundle_id, lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS path, NULL AS doc_id,
              CASE WHEN doc_id % 61 = 9 THEN text || chr(10) || 'a permission for the admin' ELSE text END AS text FROM documents))""",
        ),
        "scan_all": _scan_all_sql(static, p["kept"], p["scored"]),
        "threat_stats": _with(p["hashes"], p["known"], body="SELECT count(*) AS n_threats FROM known"),
    }
    ranked = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY {_ORDER} DESC, confidence DESC, {_MADE}) - 1 AS place FROM kept)"
    levels = f"levels AS (SELECT bundle_id, round(CAST(risk_score AS DOUBLE), 6) AS risk_score, CAST(n_findings AS BIGINT) AS n_findings, {_LEVEL} FROM scored)"
    slug = "replace(replace(category, ' · ', '_'), ' ', '_')"
    sarif_level = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
    out["report_json"] = _with(*kept, p["scored"], p["hashes"], ranked, levels, body="""SELECT l.bundle_id, hash, risk_level, risk_score, CAST(place AS BIGINT) AS place, severity, category, path AS file, CAST(line AS BIGINT) AS line, engine,
        round(CAST(confidence AS DOUBLE), 6) AS confidence FROM levels l JOIN hashes USING (bundle_id) LEFT JOIN ranked r ON l.bundle_id = r.bundle_id""")
    out["report_sarif"] = _with(*kept, ranked, body=f"""SELECT bundle_id, '2.1.0' AS version, CAST(place AS BIGINT) AS place, {slug} AS rule_id, category AS rule_name, {sarif_level} AS rule_level, {slug} AS result_rule, {sarif_level} AS level,
        path AS uri, CAST(coalesce(line, 1) AS BIGINT) AS start_line, round(CAST(confidence AS DOUBLE), 6) AS confidence, engine FROM ranked""")
    out["report_html"] = _with(*kept, p["scored"], ranked, levels, body="""SELECT l.bundle_id, l.bundle_id AS title, printf('%s %.1f/10', risk_level, risk_score) AS head, n_findings, 'static' AS layers,
        count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, coalesce(string_agg(concat_ws(':', path, line), ' ' ORDER BY place), '') AS places
        FROM levels l LEFT JOIN ranked r ON l.bundle_id = r.bundle_id GROUP BY ALL""")
    first = f"first AS (SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY {_MADE}) AS place, '- ' || severity || ': ' || category || ' in ' || path AS said FROM found)"
    body = f"""heads AS (SELECT bundle_id, left(body, {model_layer.PROMPT_BYTES}) AS body FROM bodies),
        letters AS (SELECT bundle_id, unnest(string_split(body, '')) AS c, unnest(range(length(body))) AS i FROM heads),
        cut AS (SELECT bundle_id, string_agg(c, '' ORDER BY i) AS body FROM (SELECT *, sum(strlen(c)) OVER (PARTITION BY bundle_id ORDER BY i) AS size FROM letters) WHERE size <= {model_layer.PROMPT_BYTES} GROUP BY bundle_id)"""
    prompt = f"""prompts AS (SELECT bundle_id, {sql_string(model_layer.FINDINGS_HEAD)} || coalesce(listed, 'None') || {sql_string(model_layer.BUNDLE_HEAD)} || body AS prompt FROM cut
        LEFT JOIN (SELECT bundle_id, string_agg(said, chr(10) ORDER BY place) AS listed FROM first WHERE place <= {model_layer.PROMPT_FINDINGS} GROUP BY bundle_id) USING (bundle_id))"""
    asked = [*static, p["bodies"], first, body, prompt]
    out["llm_prompt"] = _with(*asked, body="SELECT bundle_id, sha256(prompt) AS prompt_sha256, CAST(strlen(prompt) AS BIGINT) AS n_bytes FROM prompts")
    out["model_requests"] = _with(*asked, body=f"""SELECT bundle_id, 'some-model' AS model, 'system' AS first_role, 'user' AS second_role, 'json_object' AS answer, '{model_layer.TEMPERATURE}' AS temperature,
        sha256(prompt) AS prompt_sha256 FROM prompts""")
    severity = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(intake.MODEL_SEVERITIES))
    out["scan_layers"] = _with(
        *asked, p["hashes"],
        f"""said AS (SELECT bundle_id, 'unknown' AS path, CAST(NULL AS BIGINT) AS line, CASE strlen(prompt) % {len(intake.MODEL_SEVERITIES)} {severity} END AS severity, 'Model' AS category, 'llm' AS engine,
            CAST(0.6 AS DOUBLE) AS confidence, 4 AS layer_ord, 0 AS n FROM prompts WHERE strlen(prompt) % 7 > 1)""",
        "joined AS (SELECT bundle_id, path, line, severity, category, engine, confidence, layer_ord, n FROM found UNION ALL SELECT * FROM said)",
        p["kept"].replace("FROM found", "FROM joined"), p["scored"],
        body=f"""SELECT bundle_id, hash, CAST(n_findings AS BIGINT) AS n_findings, round(CAST(risk_score AS DOUBLE), 6) AS risk_score, {_LEVEL}, coalesce(worst >= 2, false) AS fails, 'static,llm' AS layers
            FROM scored JOIN hashes USING (bundle_id)""",
    )
    out |= intake_queries.oracle_sql(p["hashes"], [*kept, p["scored"], levels])
    return out | {f"sig_sd{i:02d}": _with(p["texts"], p["hits"], body=f"{sig} WHERE starts_with(rule_id, 'SD{i:02d}_')") for i in range(1, 11)}
