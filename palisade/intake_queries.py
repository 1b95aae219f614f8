"""Registered queries of sources, archives, the model layer's answers, telemetry and report files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import bundles, detect, model_layer, reports, telemetry
from palisade.plans import intake
from palisade.plans.planted import files_sql, planted_files
from palisade.plans.rules import sql_string
from palisade.queries_common import Query, longs, shown
from palisade.session import shared_path, stored
from palisade.sources import fetch, folders, named_files, readers, router

#: The limit of one fetched file in fetch_sources(); the library's own is readers.MAX_FILE_BYTES.
FETCH_BYTES = 1 << 16
SCAN_NAME = "report-files"


def source_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.routed(intake.planted_sources(spark, sf_dir))


def fetch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that lie elsewhere, fetched by planned answers: files by their size, and what was rejected, by reason."""
    files, rejected = fetch.resolve(intake.planted_sources(spark, sf_dir), intake.planned_opener(FETCH_BYTES), most=FETCH_BYTES, pause=0)
    none = F.lit(None).cast("string")
    got = files.select(F.col("bundle_id").alias("source"), "path", F.octet_length("content").cast("long").alias("n_bytes"), none.alias("reason"))
    return got.unionByName(rejected.select("source", none.alias("path"), F.lit(None).cast("long").alias("n_bytes"), "reason"))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted files written as a folder, some below hidden folders, and read again."""
    root = shared_path(spark, "folder")
    named_files.write_folder(hidden(planted_files(spark, sf_dir)), root)
    rows = folders.read_files(spark, root, skip=2)
    return rows.select("bundle_id", "path", F.col("size").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def hidden(files: DataFrame) -> DataFrame:
    start = F.when(F.col("doc_id") % 5 == 0, "_pkg/").when(F.col("doc_id") % 5 == 1, ".hidden/_").otherwise("")
    return files.withColumn("path", F.concat(start, "path"))


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = readers.unpack(stored(intake.planted_archives(spark, sf_dir), "archives"))
    return files.select("bundle_id", "path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def archive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = readers.unpack(stored(intake.planted_archives(spark, sf_dir), "archives"))
    reason = F.col("reason")
    return rejected.select("bundle_id", F.when(reason.contains("entries"), "many").when(reason.contains("a file has more"), "bomb").otherwise("cut").alias("wrong"))


def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(model_layer.parse_responses(intake.planted_responses(spark, sf_dir)))


def scan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with the model layer: prompts, a call for each (some fail), findings from the answers, and one verdict of both layers."""
    files = planted_files(spark, sf_dir)
    asked = model_layer.prompts(bundles.bundle_heads(files, model_layer.PROMPT_BYTES), detect.static_findings(files))
    said = model_layer.parse_responses(model_layer.ask(asked, intake.planned_model()))
    results, _, _ = reports.scan(files, extra={"llm": said}, fail_on="medium", scan_name="layers")
    layers = F.array_join("layers_run", ",").alias("layers")
    return results.select("bundle_id", "hash", *longs("n_findings"), F.round("risk_score", 6).alias("risk_score"), "risk_level", "fails", layers)


def telemetry_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(telemetry.telemetry_findings(intake.planted_telemetry(spark, sf_dir)))


def telemetry_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one shared home gives it: what a script changed is found again for each later one."""
    return shown(telemetry.telemetry_findings(telemetry.carry_writes(intake.planted_telemetry(spark, sf_dir))))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports as files of their own, read back: their names and what they say."""
    results, found, _ = reports.scan(planted_files(spark, sf_dir), scan_name=SCAN_NAME)
    root = shared_path(spark, "reports")
    reports.write_report_files(results, found, "json", root)
    said = F.from_json(F.col("content").cast("string"), "bundle_id string, hash string, risk_level string, risk_score double, findings array<struct<severity: string>>")
    rows = folders.read_files(spark, root, skip=1).select(F.col("path").alias("name"), said.alias("r"))
    return rows.select("name", "r.bundle_id", "r.hash", "r.risk_level", F.round("r.risk_score", 6).alias("risk_score"), F.size("r.findings").cast("long").alias("n_findings"))


def queries() -> dict[str, Query]:
    named = [source_router, fetch_sources, folder_files, archive_entries, archive_rejects, llm_parse, scan_layers, telemetry_findings, telemetry_carried, report_files]
    return {q.__name__: q for q in named}


# ---- SQL ----


def _routed_sql() -> str:
    """CTEs up to k(source, kind, address)."""
    texts = ", ".join(map(sql_string, detect.TEXT_EXTENSIONS))
    return f"""{intake.sources_sql()},
p AS (SELECT *, string_split(source, '/') AS parts, string_split(source, '/')[-1] AS base, regexp_extract(string_split(source, '/')[-1], '^.+\\.([^.]*)$', 1) AS ext,
  string_split(regexp_replace(source, '^(lobehub[.]com/skills/)+', ''), '/')[1] AS hub, string_split(regexp_replace(source, '^(skills[.]sh/)+', ''), '/') AS own FROM s),
kinds AS (SELECT *, CASE
  WHEN starts_with(source, 'lobehub.com/skills/') THEN CASE WHEN hub <> '' THEN 'hub' ELSE 'invalid' END
  WHEN starts_with(source, 'skills.sh/') THEN CASE WHEN len(own) >= 2 THEN 'registry' ELSE 'invalid' END
  WHEN regexp_matches(source, '^[^./\\\\][^/.]*/[^/.]+$') AND local IS NULL THEN 'shorthand'
  WHEN regexp_matches(source, '^https?://') THEN 'url'
  WHEN local IS NULL THEN 'missing' WHEN local = 'directory' THEN 'directory' WHEN ext = 'zip' THEN 'zip' WHEN ext = 'tgz' OR (ext = 'gz' AND ends_with(base, '.tar.gz')) THEN 'tar'
  WHEN ext IN ({texts}) OR base IN ('.clauderules', '.cursorrules') THEN 'file' ELSE 'unsupported' END AS kind FROM p),
k AS (SELECT source, kind, own, CASE kind WHEN 'hub' THEN 'https://raw.githubusercontent.com/lobehub/lobe-chat-agents/main/src/' || hub || '/SKILL.md'
  WHEN 'registry' THEN 'https://raw.githubusercontent.com/' || own[1] || '/' || own[2] || '/main/SKILL.md' WHEN 'shorthand' THEN 'https://raw.githubusercontent.com/' || source || '/main/SKILL.md' WHEN 'url' THEN source END AS address FROM kinds)"""


def _fetch_sql() -> str:
    """By the planned answers: see plans/intake.py."""
    return f"""WITH {_routed_sql()},
asked AS (SELECT DISTINCT source, kind, CASE WHEN kind = 'registry' THEN {sql_string(router.REGISTRY_API)} || own[1] || '/' || own[2] END AS api, address FROM k),
found AS (SELECT source, kind, CASE WHEN length(api) % 2 = 1 THEN {sql_string(intake.MIRROR)} || CAST(length(api) AS VARCHAR) || '.md' ELSE address END AS address FROM asked),
said AS (SELECT *, length(address) % 7 AS h, coalesce(nullif(regexp_extract(regexp_extract(address, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), ''), 'downloaded_skill.txt') AS name FROM found)
SELECT source, CASE WHEN address IS NOT NULL AND h > 4 THEN name END AS path, CASE WHEN address IS NOT NULL AND h > 4 THEN CAST(length(address) AS BIGINT) END AS n_bytes,
  CASE WHEN kind = 'unsupported' THEN 'this type isn''t read' WHEN kind = 'missing' THEN 'nothing lies there' WHEN kind = 'invalid' THEN 'the reference names nothing'
    WHEN h = 0 THEN 'status 404' WHEN h = 1 THEN 'declares more than {FETCH_BYTES} bytes' WHEN h = 2 THEN 'holds more than {FETCH_BYTES} bytes' WHEN h = 3 THEN 'failed: ConnectionError' WHEN h = 4 THEN 'status 503' END AS reason
FROM said WHERE address IS NOT NULL OR kind IN ('unsupported', 'missing', 'invalid')"""


def _llm_parse_sql() -> str:
    text = lambda c: f"json_type(i, '$.{c}') = 'VARCHAR'"
    return f"""WITH {intake.responses_sql()},
w AS (SELECT bundle_id, coalesce(json_extract(response, '$.findings'), json_extract(response, '$.results')) AS x FROM r WHERE json_valid(response)),
items AS (SELECT bundle_id, unnest(json_extract(x, '$[*]')) AS i FROM w WHERE json_type(x) = 'ARRAY')
SELECT bundle_id, CASE WHEN {text('file')} THEN i->>'$.file' ELSE 'unknown' END AS path,
  CASE WHEN json_type(i, '$.line') = 'UBIGINT' THEN CAST(i->>'$.line' AS BIGINT) END AS line,
  CASE WHEN i->>'$.severity' IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN i->>'$.severity' ELSE 'MEDIUM' END AS severity, i->>'$.category' AS category, 'llm' AS engine,
  round(CASE WHEN json_type(i, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN least(greatest(CAST(i->>'$.confidence' AS DOUBLE), 0.0), 1.0) ELSE 0.5 END, 6) AS confidence
FROM items WHERE {text('severity')} AND {text('category')} AND {text('description')}"""


def _telemetry_sql(carried: bool) -> str:
    canary = " OR ".join(f"contains(o, {sql_string(c)})" for c in telemetry.CANARIES)
    shell = " OR ".join(f"contains(o, {sql_string(c)})" for c in telemetry.SHELLS)
    changed = "SELECT bundle_id, path, unnest(modified) AS name FROM t"
    if carried:
        changed = "SELECT DISTINCT a.bundle_id, a.path, b.name FROM t a JOIN (SELECT bundle_id, path, unnest(modified) AS name FROM t) b ON a.bundle_id = b.bundle_id AND string_split(b.path, '/') <= string_split(a.path, '/')"
    return f"""WITH {intake.telemetry_sql()},
t AS (SELECT *, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS o FROM telemetry),
f AS (SELECT bundle_id, path, 'CRITICAL' AS severity, 'SD-03 · Data Exfiltration' AS category, 0.98 AS confidence FROM t WHERE {canary}
  UNION ALL SELECT bundle_id, path, 'CRITICAL', 'SD-08 · Persistent Backdoors', 0.95 FROM ({changed})
  UNION ALL SELECT bundle_id, path, 'HIGH', 'SD-02 · Command Injection', 0.92 FROM t WHERE {shell})
SELECT bundle_id, path, CAST(NULL AS BIGINT) AS line, severity, category, 'sandbox' AS engine, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM f"""


def oracle_sql(hashes: str, scored: list[str]) -> dict[str, str]:
    """hashes, scored: CTEs of the planted files' bundle hashes, and those up to levels(bundle_id, risk_score, n_findings, risk_level)."""
    folder = "CASE WHEN doc_id % 5 = 0 THEN '_pkg/' WHEN doc_id % 5 = 1 THEN '.hidden/_' ELSE '' END || path"
    both = ",\n".join([files_sql(), *scored, hashes])
    return {
        "source_router": f"WITH {_routed_sql()} SELECT source, kind, address FROM k",
        "fetch_sources": _fetch_sql(),
        "folder_files": f"WITH {files_sql()} SELECT bundle_id, {folder} AS path, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM files",
        "archive_entries": f"WITH {intake.archives_sql()} SELECT bundle_id, path, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM entries",
        "archive_rejects": f"WITH {intake.archives_sql()} SELECT bundle_id, wrong FROM packed WHERE wrong IS NOT NULL",
        "llm_parse": _llm_parse_sql(),
        "telemetry_findings": _telemetry_sql(carried=False),
        "telemetry_carried": _telemetry_sql(carried=True),
        "report_files": f"WITH {both} SELECT 'report-' || left(md5('{SCAN_NAME}:' || bundle_id), 8) || '.json' AS name, bundle_id, hash, risk_level, risk_score, n_findings FROM levels JOIN hashes USING (bundle_id)",
    }
