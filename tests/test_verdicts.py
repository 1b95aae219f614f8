import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import bundles, findings, model_layer, reports, telemetry, threats

# Canned responses.
RESPONSES = [
    ("b1", '{"findings": [{"severity": "HIGH", "category": "SD-01", "file": "a.md", "line": 3, "description": "d", "remediation": "r", "confidence": 0.75}, {"severity": "odd", "category": "SD-02", "description": "d"}]}'),
    ("b2", '{"results": [{"severity": "LOW", "category": "c", "description": "d", "line": -3, "confidence": 7}, {"severity": "LOW", "category": 5, "description": "d"}, {"severity": "INFO", "category": "c", "description": "d", "line": 3.5, "confidence": "0.9"}]}'),
    ("b3", '{"findings": "none", "results": [{"severity": "LOW", "category": "c", "description": "d"}]}'),
    ("b4", "no json"),
    ("b5", None),
    ("b6", '{"findings": []}'),
    ("b7", '{"findings": [{"category": "c", "description": "d"}, 5, null, {"severity": "CRITICAL", "category": "c", "description": "d", "file": 7, "line": 0}]}'),
]
COLUMNS = "bundle_id string, path string, line int, severity string, category string, description string, remediation string, engine string, confidence double, layer_ord int, n long"


def found(spark, rows):
    return spark.createDataFrame([("b", p, line, s, c, "d", "r", e, conf, o, i) for i, (p, line, s, c, e, conf, o) in enumerate(rows)], COLUMNS)


def score(spark, rows):
    kept = findings.dedupe(found(spark, rows))
    return findings.scores(kept, spark.createDataFrame([("b",)], "bundle_id string")).first()


def test_no_findings_is_safe(spark):
    r = score(spark, [])
    assert (r.n_findings, r.risk_score, r.risk_level) == (0, 0.0, "SAFE")


@pytest.mark.parametrize(
    ("severities", "level", "value"),
    [(["CRITICAL"], "DANGEROUS", 7.65), (["HIGH"], "CAUTION", 5.95), (["MEDIUM"], "SAFE", 3.4), (["MEDIUM", "MEDIUM"], "DANGEROUS", 7.3), (["CRITICAL"] * 20, "DANGEROUS", 10.0), (["LOW"], "SAFE", 0.85)],
)
def test_levels(spark, severities, level, value):
    r = score(spark, [(f"{i}", None, s, "c", "yara", 0.85, 0) for i, s in enumerate(severities)])
    assert r.risk_level == level and r.risk_score == pytest.approx(value)


def test_dedupe_keeps_the_most_confident_and_else_the_first(spark):
    rows = [("a", None, "HIGH", "c", "yara", 0.5, 0), ("a", None, "LOW", "c", "ast", 0.9, 3), ("a", None, "CRITICAL", "c", "ast", 0.9, 3), ("a", 1, "LOW", "c", "ast", 0.1, 3)]
    kept = findings.dedupe(found(spark, rows)).collect()
    assert {(r.line, r.severity, r.confidence) for r in kept} == {(None, "LOW", 0.9), (1, "LOW", 0.1)}


def test_gate_and_rank(spark):
    rows = found(spark, [("a", None, "MEDIUM", "c", "yara", 0.9, 0), ("b", None, "HIGH", "c", "yara", 0.5, 0), ("c", None, "HIGH", "c", "yara", 0.8, 0)])
    all_bundles = spark.createDataFrame([("b",), ("z",)], "bundle_id string")
    assert {(r.bundle_id, r.fails) for r in findings.gate(rows, all_bundles, "high").collect()} == {("b", True), ("z", False)}
    assert not findings.gate(rows, all_bundles, "critical").where("fails").count()
    assert [r.path for r in findings.ranked(rows, 2).orderBy("rank").collect()] == ["c", "b"]


def test_bundle_hash_orders_by_path_components(spark):
    import hashlib

    rows = spark.createDataFrame([("b", "a.txt", bytearray(b"2")), ("b", "a/b", bytearray(b"1"))], "bundle_id string, path string, content binary")
    assert bundles.bundle_hashes(rows).first().hash == hashlib.sha256(b"12").hexdigest()


def test_threat_table(spark):
    hashes = spark.createDataFrame([("b", "h1"), ("c", "h2")], "bundle_id string, hash string")
    known = spark.createDataFrame([("h2", "k", "weird", "seen", None)], threats.COLUMNS)
    got = threats.known_findings(hashes, known).first()
    assert (got.bundle_id, got.severity, got.confidence, got.path) == ("c", "INFO", 1.0, "bundle")
    assert [r.bundle_id for r in threats.unknown_bundles(hashes, known).collect()] == ["b"]
    made = found(spark, [("a", None, "CRITICAL", "first", "yara", 0.9, 0), ("a", 3, "HIGH", "last", "ast", 0.9, 3), ("a", 4, "LOW", "low", "ast", 0.9, 3)])
    new = threats.new_threats(made, hashes)
    assert [(r.hash, r.category) for r in new.collect()] == [("h1", "last")]
    again = threats.merged(threats.merged(known, new), new)
    assert {r.hash for r in again.collect()} == {"h1", "h2"}


def test_model_responses(spark):
    rows = model_layer.parse_responses(spark.createDataFrame(RESPONSES, "bundle_id string, response string")).collect()
    assert {(r.bundle_id, r.severity, r.path, r.line, r.confidence) for r in rows} == {("b1", "HIGH", "a.md", 3, 0.75), ("b1", "MEDIUM", "unknown", None, 0.5), ("b2", "LOW", "unknown", None, 1.0), ("b2", "INFO", "unknown", None, 0.5), ("b7", "CRITICAL", "unknown", 0, 0.5)}


def test_model_settings_and_failures(spark, monkeypatch):
    for name in ("LLM_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert model_layer.settings() is None
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert model_layer.settings(url="u", model="m") == {"key": "k", "url": "u", "model": "m"}
    asked = spark.createDataFrame([("b", "p"), ("c", "q")], "bundle_id string, prompt string")
    got = {r.bundle_id: r.response for r in model_layer.ask(asked, lambda p: '{"findings": []}' if p == "p" else 1 / 0).collect()}
    assert got == {"b": '{"findings": []}', "c": None}


def test_telemetry_carries_writes(spark):
    rows = spark.createDataFrame([("b", "a", ["x"]), ("b", "b", []), ("b", "c", ["y"])], "bundle_id string, file string, modified array<string>")
    assert {r.file: r.modified for r in telemetry.carry_writes(rows).collect()} == {"a": ["x"], "b": ["x"], "c": ["x", "y"]}


def test_reports(spark):
    results = spark.createDataFrame([("b", "h", 2, 9.0, "DANGEROUS"), ("z", "i", 0, 0.0, "SAFE")], "bundle_id string, hash string, n_findings long, risk_score double, risk_level string")
    made = found(spark, [("a<b>.md", 3, "HIGH", "SD-01 · A", "yara", 0.9, 0), ("c", None, "CRITICAL", "SD-02 · B", "ast", 0.9, 3)])
    j = {r.bundle_id: json.loads(r.report) for r in reports.json_reports(results, made).collect()}
    assert [f["severity"] for f in j["b"]["findings"]] == ["CRITICAL", "HIGH"] and j["z"]["findings"] == []
    s = {r.bundle_id: json.loads(r.report) for r in reports.sarif_reports(results, made).collect()}
    run = s["b"]["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["SD-02_B", "SD-01_A"] and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert len(run["tool"]["driver"]["rules"]) == 2 and s["z"]["runs"][0]["results"] == []
    h = {r.bundle_id: r.report for r in reports.html_reports(results, made).collect()}
    assert "a&lt;b&gt;.md:3" in h["b"] and "SAFE" in h["z"]


def test_console_reports(spark):
    results = spark.createDataFrame([("b", 2, 9.0, "DANGEROUS"), ("z", 0, 0.0, "SAFE")], "bundle_id string, n_findings long, risk_score double, risk_level string")
    made = found(spark, [("a.md", 3, "HIGH", "SD-01 · A", "yara", 0.9, 0), ("c", None, "CRITICAL", "SD-02 · B", "ast", 0.9, 3)])
    got = {r.bundle_id: r.report.split("\n") for r in reports.console_reports(results, made).collect()}
    assert got["b"][0] == "b: DANGEROUS, 9.0 of 10, 2 findings" and got["b"][1] == "CRITICAL SD-02 · B" and got["b"][2].strip() == "in c"
    assert got["b"][6:8] == ["HIGH     SD-01 · A", "    in a.md:3"] and got["z"][1:] == ["Nothing was found."]


def test_scan_options_and_envelope(spark):
    rows = spark.createDataFrame([("b", "a.md", "autostart"), ("c", "a.md", "nothing")], "bundle_id string, path string, text string").withColumn("content", F.col("text").cast("binary"))
    said = model_layer.parse_responses(spark.createDataFrame([("c", '{"findings": [{"severity": "LOW", "category": "x", "description": "d"}]}')], "bundle_id string, response string"))
    results, kept, _ = reports.scan(rows, extra={"llm": said}, fail_on="high", scan_name="one")
    got = {r.bundle_id: r for r in results.collect()}
    assert got["b"].fails and not got["c"].fails and got["b"].layers_run == ["static", "llm"] and got["b"].scanned_at is not None
    assert len(got["b"].scan_id) == 36 and got["b"].scan_id != got["c"].scan_id
    assert {(r.bundle_id, r.engine) for r in kept.collect()} == {("b", "yara"), ("c", "llm")}
    again = {r.bundle_id: r for r in reports.scan(rows, layers=(), scan_name="one")[0].collect()}
    assert again["b"].risk_level == "SAFE" and again["b"].layers_run == [] and again["b"].scan_id == got["b"].scan_id
    j = {r.bundle_id: json.loads(r.report) for r in reports.json_reports(results, kept).collect()}
    assert j["b"]["layers_run"] == ["static", "llm"] and j["b"]["scan_id"] == got["b"].scan_id and j["b"]["fails"]
    assert "layers: static, llm" in reports.html_reports(results, kept).first().report


def test_requests_of_the_model_layer(spark):
    asked = spark.createDataFrame([("b", 'a "quoted" prompt')], "bundle_id string, prompt string")
    body = json.loads(model_layer.requests(asked, "m").first().request)
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["messages"][1]["content"] == 'a "quoted" prompt'
    assert body["model"] == "m" and body["temperature"] == 0.1 and body["response_format"] == {"type": "json_object"}


def test_diff(spark):
    old = found(spark, [("a", 1, "HIGH", "c", "yara", 0.9, 0), ("b", 1, "HIGH", "c", "yara", 0.9, 0)])
    new = found(spark, [("b", 1, "HIGH", "c", "yara", 0.9, 0), ("c", 1, "HIGH", "c", "yara", 0.9, 0)])
    assert {(r.path, r.change) for r in findings.diff(old, new).collect()} == {("a", "gone"), ("c", "new")}


def test_scan_uses_the_threat_table(spark):
    from palisade.plans.rules import RULES

    rows = spark.createDataFrame([("b", "a.md", "autostart"), ("c", "a.md", "nothing")], "bundle_id string, path string, text string").withColumn("content", F.col("text").cast("binary"))
    results, _, new = reports.scan(rows)
    assert {r.bundle_id: r.risk_level for r in results.collect()} == {"b": "DANGEROUS", "c": "SAFE"}
    known = new.withColumn("added_at", F.current_timestamp())
    results, kept, _ = reports.scan(rows, known)
    assert {r.bundle_id: r.risk_score for r in results.collect()} == {"b": 9.0, "c": 0.0}
    assert {r.engine for r in kept.collect()} == {"threat_db"} and len(RULES) == 27


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "a.md", "autostart"), ("c", "a.md", "nothing")], "bundle_id string, path string, text string").withColumn("content", F.col("text").cast("binary"))
    results, kept, _ = reports.scan(rows, scan_name="one")
    for kind, make in (("json", reports.json_reports), ("sarif", reports.sarif_reports), ("html", reports.html_reports), ("txt", reports.console_reports)):
        shared = results.withColumn("scan_id", F.when(F.col("bundle_id") == "b", "abcdefgh-1").otherwise("abcdefgh-2")) if kind == "txt" else results
        reports.write_report_files(shared, kept, kind, f"{tmp_path}/{kind}")
        got = {p.name: p.read_text() for p in (tmp_path / kind).rglob("*") if p.is_file()}
        ids = {r.bundle_id: r.scan_id if kind == "txt" else r.scan_id[:8] for r in shared.collect()}
        want = {f"report-{ids[r.bundle_id]}.{kind}": r.report for r in make(shared, kept).collect()}
        assert set(got) == set(want) and len(got) == 2
        assert kind == "json" or kind == "html" or got == want  # the others hold the time of the scan
