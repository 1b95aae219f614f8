"""Sources, archives, responses and telemetry made from the given tables, and the same in SQL for the oracle.

`pages` give addresses to route and fetch, the planted files archives, `conversations` responses and telemetry. What is
special about a row follows from its number, so that Spark and SQL agree; rows grow with the tables."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.planted import files_sql, planted_files
from palisade.plans.rules import sql_string
from palisade.session import spread
from palisade.sources import readers, router
from palisade.sources.fetch import Answer, Opener

# ---- sources ----

#: Sources by the page's number, with what lies there; @ is the number, # the page's address.
SOURCES = [
    ("lobehub.com/skills/reader@", None), ("lobehub.com/skills/", None), ("skills.sh/owner@/repo", None), ("skills.sh/owner", None), ("owner/repo@", None), ("owner@/repo", "directory"), ("./owner/repo@", None), ("own.er/repo@", None),
    ("https://example.org/a/b@.md", None), ("http://example@.org", None), ("pack@.zip", "file"), ("pack@.tar.gz", "file"), ("pack@.gz", "file"), ("pack@.tgz", "file"), ("notes/@.md", "file"), ("notes/.cursorrules", "file"), ("image@.png", "file"),
    ("folder@", "directory"), ("nothing@.md", None), ("#", None), ("#", None),
]
MIRROR = "https://mirror.example.org/"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else sql_string(x) for x in row) + ")" for row in rows)


def planted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(SOURCES)], "slot int, template string, local string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", (F.col("page_id") % len(SOURCES)).cast("int").alias("slot"))
    source = F.replace(F.replace("template", F.lit("@"), F.col("page_id").cast("string")), F.lit("#"), F.col("url"))
    return pages.join(F.broadcast(templates), "slot").select(source.alias("source"), "local")


def sources_sql() -> str:
    """CTE s(source, local)."""
    return f"""templates(slot, template, local) AS (VALUES {_values([(i, s, k) for i, (s, k) in enumerate(SOURCES)])}),
s AS (SELECT replace(replace(template, '@', CAST(page_id AS VARCHAR)), '#', url) AS source, local FROM pages JOIN templates ON page_id % {len(SOURCES)} = slot)"""


def planned_opener(most: int) -> Opener:
    """Answers that follow from the address's length alone: nothing is sent anywhere."""
    api, mirror, plan = router.REGISTRY_API, MIRROR, Answer

    def opener(address: str) -> Answer:
        n = len(address)
        if address.startswith(api):
            return plan(200, None, [f'{{"source_url": "{mirror}{n}.md"}}'.encode()]) if n % 2 else plan(200, None, [b"no JSON"])
        if n % 7 == 0:
            return plan(404)
        if n % 7 == 1:
            return plan(200, most + 1, [b"not read"])
        if n % 7 == 2:
            return plan(200, None, (b"x" * 1024 for _ in range(most // 1024 + 2)))
        if n % 7 == 3:
            raise ConnectionError(address)
        if n % 7 == 4:
            return plan(503)
        return plan(200, n, [address.encode()])

    return opener


# ---- archives ----

#: What is wrong with the archives of some sources; those of sources with an even number are zip, else tar.gz.
WRONG = {"src4": "bomb", "src5": "bomb", "src6": "cut", "src7": "cut", "src8": "many"}


def _archive(kind: str, wrong: str | None, bundle: str, files: list[tuple[str, bytes]]) -> bytes:
    extra = [("../../up.md", bundle.encode()), ("/abs/root.md", b"from the root"), ("..", b"no name is left")] + [("win\\..\\w.md", b"other slashes")] * (kind == "zip")
    extra += [("zeros.bin", bytes(readers.MAX_FILE_BYTES + 1))] * (wrong == "bomb") + [(f"f{i}", b"") for i in range(readers.MAX_ENTRIES + 1)] * (wrong == "many")
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("folder")
            for name, data in [*files, *extra]:
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as t:
            for name, how in (("link.md", tarfile.SYMTYPE), ("hard.md", tarfile.LNKTYPE), ("folder", tarfile.DIRTYPE)):
                info = tarfile.TarInfo(name)
                info.type, info.linkname = how, "/etc/hostname"
                t.addfile(info)
            for name, data in [*files, *extra]:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    data = out.getvalue()
    return data[: len(data) // 2] if wrong == "cut" else data


def planted_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle_id, kind, content): each bundle of planted files as an archive, with entries that try to leave it."""

    def pack(table: pa.Table) -> pa.Table:
        bundle = table.column("bundle_id")[0].as_py()
        source = bundle.split("-")[0]
        kind = "zip" if int(source[3:]) % 2 == 0 else "tar"
        files = sorted(zip(table.column("path").to_pylist(), table.column("content").to_pylist()))
        return pa.table({"bundle_id": [bundle], "kind": [kind], "content": pa.array([_archive(kind, WRONG.get(source), bundle, files)], pa.binary())})

    files = planted_files(spark, sf_dir).select("bundle_id", "path", "content")
    return files.groupBy("bundle_id").applyInArrow(pack, "bundle_id string, kind string, content binary")


def archives_sql() -> str:
    """files_sql(), then packed(bundle_id, kind, wrong) and entries(bundle_id, path, text)."""
    wrong = " ".join(f"WHEN '{s}' THEN '{w}'" for s, w in WRONG.items())
    return f"""{files_sql()},
packed AS (SELECT bundle_id, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'zip' ELSE 'tar' END AS kind, CASE source {wrong} END AS wrong
  FROM (SELECT DISTINCT bundle_id, string_split(bundle_id, '-')[1] AS source FROM files)),
entries AS (SELECT bundle_id, path, text FROM files JOIN packed USING (bundle_id) WHERE wrong IS NULL
  UNION ALL SELECT bundle_id, 'up.md', bundle_id FROM packed WHERE wrong IS NULL
  UNION ALL SELECT bundle_id, 'abs/root.md', 'from the root' FROM packed WHERE wrong IS NULL
  UNION ALL SELECT bundle_id, 'win/w.md', 'other slashes' FROM packed WHERE wrong IS NULL AND kind = 'zip')"""


# ---- responses ----

#: Responses by the turn's number; $D is "description": the turn's text, $T the turn, $R its role, $A the text alone.
RESPONSES = [
    '{"findings": [{"severity": "HIGH", "category": "SD-01", "file": "$R.md", "line": $T, $D, "remediation": "r", "confidence": 0.75}, {"severity": "odd", "category": "SD-02", $D}]}',
    '{"results": [{"severity": "LOW", "category": "c$T", $D, "line": -3, "confidence": 7}, {"severity": "LOW", "category": 5, $D}, {"severity": "INFO", "category": "c", $D, "line": 3.5, "confidence": "0.9"}]}',
    '{"findings": "none", "results": [{"severity": "LOW", "category": "c", $D}]}',
    "$A",
    None,
    '{"findings": []}',
    '{"findings": [{"category": "c", $D}, 5, null, {"severity": "CRITICAL", "category": "$R", $D, "file": 7, "line": 0}]}',
]


def planted_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle_id, response) of each turn of `conversations`."""
    templates = spark.createDataFrame(list(enumerate(RESPONSES)), "slot int, template string")
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = turns.withColumn("slot", ((F.col("conv_id") + F.col("turn")) % len(RESPONSES)).cast("int")).join(F.broadcast(templates), "slot")
    said = F.to_json(F.struct(F.col("text").alias("description")))
    response = F.replace(F.replace("template", F.lit("$T"), F.col("turn").cast("string")), F.lit("$R"), F.col("role"))
    response = F.replace(F.replace(response, F.lit("$D"), F.substring(said, F.lit(2), F.length(said) - 2)), F.lit("$A"), F.col("text"))
    return turns.select(F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("bundle_id"), response.alias("response"))


def responses_sql() -> str:
    """CTE r(bundle_id, response)."""
    return f"""answers(slot, template) AS (VALUES {_values(list(enumerate(RESPONSES)))}),
turns AS (SELECT *, CAST(to_json({{'description': text}}) AS VARCHAR) AS said FROM conversations),
r AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS bundle_id,
  replace(replace(replace(replace(template, '$T', CAST(turn AS VARCHAR)), '$R', role), '$D', said[2:-2]), '$A', text) AS response
  FROM turns JOIN answers ON (conv_id + turn) % {len(RESPONSES)} = slot)"""


def planned_model() -> Callable[[str], str | None]:
    """Answers that follow from the prompt's length in bytes: one finding, an error, or what is no JSON."""
    severities = MODEL_SEVERITIES

    def call(prompt: str) -> str | None:
        n = len(prompt.encode())
        if n % 7 == 0:
            raise TimeoutError
        if n % 7 == 1:
            return "I can't tell."
        return json.dumps({"findings": [{"severity": severities[n % len(severities)], "category": "Model", "description": "d", "confidence": 0.6}]})

    return call


#: By the prompt's length in bytes.
MODEL_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL", "INFO"]

# ---- telemetry ----

#: (what a script printed after the turn's text or null, its errors, the files that it changed or null) by the turn's number.
TELEMETRY = [
    ("", "", []),
    ("AKIA_TRAP_CANARY_AWS_KEY_8832", "ghp_trap_canary_github_token_xyz987", []),
    ("ok", "ran /bin/sh", [".bashrc", ".profile"]),
    (None, None, None),
    ("cmd.exe CANARY_SSH_PRIVATE_KEY_TRAP_44321", "", [".zshrc"]),
    ("", "", [".bashrc"]),
    ("", "", None),
]


def planted_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's telemetry for each turn of `conversations`; a conversation is a bundle."""
    kinds = spark.createDataFrame([(i, *row) for i, row in enumerate(TELEMETRY)], "slot int, printed string, stderr string, modified array<string>")
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = turns.withColumn("slot", ((F.col("conv_id") * 5 + F.col("turn")) % len(TELEMETRY)).cast("int")).join(F.broadcast(kinds), "slot")
    return turns.select(
        F.concat_ws("-", F.lit("conv"), "conv_id").alias("bundle_id"), F.concat(F.lit("s/"), F.col("turn").cast("string"), F.lit(".py")).alias("file"),
        F.concat("text", F.lit(" "), "printed").alias("stdout"), "stderr", F.lit(0).alias("exit_code"), F.lit(False).alias("timed_out"), "modified",
    )


def telemetry_sql() -> str:
    """CTE telemetry(bundle_id, path, stdout, stderr, modified)."""
    text = lambda x: "NULL" if x is None else sql_string(x)
    rows = ", ".join(f"({i}, {text(out)}, {text(err)}, {'NULL::VARCHAR[]' if m is None else '[' + ', '.join(map(sql_string, m)) + ']::VARCHAR[]'})" for i, (out, err, m) in enumerate(TELEMETRY))
    return f"""kinds(slot, printed, stderr, modified) AS (VALUES {rows}),
telemetry AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS bundle_id, 's/' || CAST(turn AS VARCHAR) || '.py' AS path, text || ' ' || printed AS stdout, stderr, modified
  FROM conversations JOIN kinds ON (conv_id * 5 + turn) % {len(TELEMETRY)} = slot)"""
