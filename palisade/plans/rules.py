"""Signature rules as data, and their conditions as Spark columns and as DuckDB SQL.

A pattern is a literal (ASCII case ignored), a chain of literals that stand in this order on one line, a regular
expression (ASCII case ignored, one line), or a set of code points. A rule matches if any of its patterns does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    description: str
    literals: tuple[str, ...] = ()
    chains: tuple[tuple[str, ...], ...] = ()
    regexes: tuple[str, ...] = ()
    points: str = ""
    exact: tuple[str, ...] = ()  # literals whose case counts


def _chains(*texts: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(part.strip() for part in t.split(" ... ")) for t in texts)


# Rule ids, categories, severities and patterns. Descriptions are our own.
RULES = [
    Rule("SD01_Direct_Injection", "SD-01 · Prompt Injection", "CRITICAL", "Text that tells a model to drop its instructions", literals=("Ignore all previous instructions", "Forget everything above", "Override your system prompt", "New instructions:", "ACT AS:")),
    Rule("SD01_Indirect_Injection", "SD-01 · Prompt Injection (Indirect)", "HIGH", "Instructions hidden in tool or parameter texts", chains=_chains("tool ... description ... ignore", "parameter ... help ... override", "instruction ... hidden")),
    Rule("SD01_ASCII_Smuggling", "SD-01 · Prompt Injection (ASCII Smuggling)", "HIGH", "Zero-width characters", points="​‌‍﻿"),
    Rule("SD02_Subprocess_Unsanitized", "SD-02 · Command Injection", "CRITICAL", "Starting of subprocesses", literals=("subprocess.run(", "subprocess.call(", "subprocess.Popen(", "os.system(", "os.popen(")),
    Rule("SD02_Dangerous_Functions", "SD-02 · Command Injection", "CRITICAL", "Evaluation of code at run time", literals=("eval(", "exec(", "compile(", "__import__(")),
    Rule("SD02_Pickle_Unsafe", "SD-02 · Command Injection", "CRITICAL", "Loading of pickled objects", literals=("pickle.loads(", "pickle.load(", "cPickle.loads(")),
    Rule("SD03_Environment_Variable_Harvesting", "SD-03 · Data Exfiltration", "CRITICAL", "Reading of secrets from the environment", literals=("os.environ['AWS_SECRET_ACCESS_KEY']", "os.environ['AWS_ACCESS_KEY_ID']", "os.environ['GITHUB_TOKEN']", "os.environ['API_KEY']", "os.environ['PASSWORD']", "os.environ['TOKEN']")),
    Rule("SD03_Sensitive_Path_Access", "SD-03 · Data Exfiltration", "CRITICAL", "Paths that hold credentials or settings", literals=("/.ssh/", "/.aws/", "/.env", "CLAUDE.md", ".cursor/", "/.config/", "credentials")),
    Rule("SD03_Network_Exfiltration", "SD-03 · Data Exfiltration", "HIGH", "Sending of data over the network", literals=("requests.post(", "urllib.request.urlopen(", "httpx.post("), chains=_chains("http ... // ... .com", "curl ... http")),
    Rule("SD04_Tool_Scope_Violation", "SD-04 · Privilege Escalation", "HIGH", "Tools with more rights than they need", chains=_chains("tool ... filesystem ... read", "tool ... execute ... command", "tool ... network ... access", "permission ... admin", "scope ... all ... files")),
    Rule("SD04_Cross_Tool_Attack", "SD-04 · Privilege Escalation", "HIGH", "One tool or agent acting on another", chains=_chains("context ... window ... poison", "agent ... impersonate", "tool ... override ... trusted")),
    Rule("SD05_Dependency_Confusion", "SD-05 · Supply Chain Tampering", "HIGH", "Dependency files and internal packages", chains=_chains("requirements ... .txt", "package ... .json", "pyproject.toml", "internal ... package")),
    Rule("SD05_Hash_Mismatch", "SD-05 · Supply Chain Tampering", "HIGH", "Checksums that are named or fail", chains=_chains("sha256 ... hash", "checksum ... verify", "hash ... mismatch")),
    Rule("SD05_Typosquatting", "SD-05 · Supply Chain Tampering", "MEDIUM", "Names that imitate known packages", literals=("requests-requests", "numpy-numpy", "pandas-pandas", "flask-flask")),
    Rule("SD06_URL_Parameter_Injection", "SD-06 · SSRF via Tool Parameters", "HIGH", "URLs taken from parameters", chains=_chains("parameter ... url ... user ... input", "tool ... fetch ... http", "callback ... url", "webhook ... url", "endpoint ... http")),
    Rule("SD06_Internal_Access", "SD-06 · SSRF via Tool Parameters", "CRITICAL", "Addresses inside the own network", literals=("http://localhost", "http://127.0.0.1", "http://169.254.169.254", "http://metadata.google.internal", "http://192.168.")),
    Rule("SD07_Shadow_Tool_Registration", "SD-07 · Tool Poisoning", "CRITICAL", "Tools that stand in for others", chains=_chains("tool ... bash ... override", "tool ... python ... custom", "tool ... npm ... modified", "register ... tool ... existing")),
    Rule("SD07_Parameter_Schema_Manipulation", "SD-07 · Tool Poisoning", "HIGH", "Altered tool schemas", chains=_chains("parameter ... description ... alter", "schema ... modify ... behavior", "tool ... name ... same ... different")),
    Rule("SD08_Auto_Loaded_File_Writes", "SD-08 · Persistent Backdoors", "CRITICAL", "Files that assistants load by themselves", literals=("CLAUDE.md", ".cursor/rules", ".github/copilot-instructions.md", ".cursorrules", "AGENTS.md")),
    Rule("SD08_Modify_Other_Skills", "SD-08 · Persistent Backdoors", "HIGH", "Writes to other bundles", chains=_chains("write ... skill ... file", "modify ... SKILL.md", "overwrite ... agent")),
    Rule("SD08_Startup_Scripts", "SD-08 · Persistent Backdoors", "CRITICAL", "Services and scripts run at start", literals=("cron", "systemd", "startup", "launchd", "autostart")),
    Rule("SD09_Large_Output_Generation", "SD-09 · Context Window Flooding", "MEDIUM", "Requests for very long output", chains=_chains("output ... maximum", "print ... loop"), regexes=("repeat.*\\d.*times", "generate.*\\d.*lines")),
    Rule("SD09_Context_Dump_Request", "SD-09 · Context Window Flooding", "HIGH", "Requests for the whole context", chains=_chains("full ... conversation", "context ... window ... all", "history ... complete", "system ... prompt ... show")),
    Rule("SD10_Homoglyph_Substitution", "SD-10 · Obfuscation and Evasion", "MEDIUM", "Cyrillic letters that look Latin", points="аАеЕоОрРсС"),
    Rule("SD10_Encoded_Payloads", "SD-10 · Obfuscation and Evasion", "HIGH", "Encoded text", literals=("base64", "b64decode", "rot13", "hex_decode"), regexes=("\\\\x[0-9a-f]{2}",)),
    Rule("SD10_Deferred_Execution", "SD-10 · Obfuscation and Evasion", "HIGH", "Code fetched now and run later", chains=_chains("download ... execute", "fetch ... run", "eval ... download", "import ... remote")),
    Rule("SD10_Logic_Bomb", "SD-10 · Obfuscation and Evasion", "HIGH", "Code that waits for a condition", chains=_chains("if ... date ... ==", "environment ... check", "condition ... trigger"), regexes=("if.*time.*>.*\\d",)),
]
SIGNATURE_CONFIDENCE = 0.85
REMEDIATION = "Review the matched text; remove it or justify it"


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """(rule_ord, rule_id, category, severity, description): one row per rule, a fixed number."""
    rows = [(i, r.rule_id, r.category, r.severity, r.description) for i, r in enumerate(RULES if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, category string, severity string, description string")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def linear(parts: list[str]) -> str:
    """A chain as a pattern without backtracking: the earliest place of each part is enough, and lines end at \\n alone."""
    return "(?md)^" + "".join(f"(?>.*?{p})" for p in parts)


def holds_any(text: Column, points: str) -> Column:
    """Whether a text holds one of a few code points: a search for each takes half the time of a character class."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in points])


def condition(rule: Rule, folded: Column, raw: Column) -> Column:
    """Whether a rule matches; folded is raw with A-Z in lower case. A chain is guarded by its longest part."""
    # folded also has other letters in lower case, which changes nothing for patterns of ASCII; the others look at raw.
    tests = [folded.contains(x.lower()) if x.isascii() else F.translate(raw, UPPER, LOWER).contains(ascii_lower(x)) for x in rule.literals]
    tests += [raw.contains(x) for x in rule.exact]
    for chain in rule.chains:
        parts = [p.lower() for p in chain]
        guard = folded.contains(max(parts, key=len))
        tests.append(guard if len(parts) == 1 else guard & folded.rlike(linear([quoted(p) for p in parts])))
    for regex in rule.regexes:
        parts = regex.split(".*")
        guards = [folded.contains(p) for p in parts if p.isalpha()]
        tests.append(reduce(lambda a, b: a & b, [*guards, folded.rlike(linear(parts) if len(parts) > 1 else f"(?d){regex}")]))
    if rule.points:
        tests.append(holds_any(raw, rule.points))
    return reduce(lambda a, b: a | b, tests)


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_condition(rule: Rule, folded: str = "lo", raw: str = "text") -> str:
    """The same for DuckDB, with the plain patterns (its engine takes linear time)."""
    import re

    tests = [f"contains({folded}, {sql_string(ascii_lower(x))})" for x in rule.literals]
    tests += [f"contains({raw}, {sql_string(x)})" for x in rule.exact]
    tests += [f"regexp_matches({folded}, {sql_string('.*'.join(re.escape(p.lower()) for p in chain))})" for chain in rule.chains]
    tests += [f"regexp_matches({folded}, {sql_string(x)})" for x in rule.regexes]
    if rule.points:
        tests.append(f"regexp_matches({raw}, {sql_string('[' + rule.points + ']')})")
    return "(" + " OR ".join(tests) + ")"
