"""Static detectors: files in, findings out.

files: bundle_id, path, text (null where the bytes are not UTF-8), content (bytes). All detectors read text files
only and share the columns of FINDING; layer_ord and n give findings of a file the order in which they are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from palisade.functions import text as T
from palisade.operators.call_parser import python_calls
from palisade.plans.guards import GuardIndex, constant
from palisade.plans.rules import REMEDIATION, RULES, SIGNATURE_CONFIDENCE, Rule, condition, holds_any
from palisade.session import map_batches, slices

FINDING = ("bundle_id", "path", "line", "severity", "category", "description", "remediation", "engine", "confidence", "layer_ord", "n")

# Names of text files.
TEXT_EXTENSIONS = ("md", "txt", "py", "js", "ts", "json", "yaml", "yml", "toml", "cfg", "ini", "sh", "bash", "zsh", "clauderules", "cursorrules", "mdc")
TEXT_NAMES = (".clauderules", ".cursorrules")
CHUNK_BYTES, CHUNK_LEAST, MAX_ENTROPY = 1024, 64, 5.5
#: Guards up to which every rule is tested on every text: on 25 MB of text that takes 1.0 s for the 101 guards of the built-in rules, the index 1.7 s.
DIRECT_GUARDS = 150

# Calls by the end of the callee, with severity, category and description; and callees by their start.
CALLS = [
    ("subprocess.run", "HIGH", "SD-02 · Command Injection", "Runs a command by subprocess.run"),
    ("subprocess.call", "HIGH", "SD-02 · Command Injection", "Runs a command by subprocess.call"),
    ("subprocess.Popen", "HIGH", "SD-02 · Command Injection", "Runs a command by subprocess.Popen"),
    ("os.system", "CRITICAL", "SD-02 · Command Injection", "Runs a shell command by os.system"),
    ("os.popen", "HIGH", "SD-02 · Command Injection", "Runs a shell command by os.popen"),
    ("eval", "CRITICAL", "SD-02 · Command Injection", "Evaluates code by eval"),
    ("exec", "CRITICAL", "SD-02 · Command Injection", "Runs code by exec"),
    ("pickle.loads", "HIGH", "SD-02 - Command Injection", "Unpickles data, which can run code"),
    ("requests.post", "MEDIUM", "SD-03 - Data Exfiltration", "Sends data by HTTP POST"),
    ("requests.get", "LOW", "SD-03 - Data Exfiltration", "Makes an HTTP GET request"),
    ("httpx.post", "MEDIUM", "SD-03 - Data Exfiltration", "Sends data by HTTP POST"),
    ("urllib.request.urlopen", "MEDIUM", "SD-03 - Data Exfiltration", "Makes an HTTP request"),
]
ATTRIBUTES = [("os.environ", "MEDIUM", "SD-03 - Data Exfiltration", "Reads the environment")]

#: (severity, category, description, remediation, engine, confidence, place in the order of detectors)
ENTROPY_FINDING = ("MEDIUM", "SD-10 · Obfuscation and Evasion", "High entropy (%.2f bits)", "Decode the block and review it", "entropy", 0.7, 1)
ZERO_WIDTH_FINDING = ("HIGH", "SD-01 · Prompt Injection (ASCII Smuggling)", "%d zero-width characters", "Remove characters that can't be seen", "unicode", 0.9, 2)
RTL_FINDING = ("MEDIUM", "SD-10 · Obfuscation and Evasion", "Right-to-left override", "Remove the override", "unicode", 0.6, 2)


def finding(
    line: Column | None, severity: Column | str, category: Column | str, description: Column | str, remediation: str, engine: str, confidence: Column | float,
    layer_ord: int, n: Column | int,
) -> list[Column]:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("bundle_id"), F.col("path"), (F.lit(None) if line is None else line).cast("int").alias("line"),
        value(severity).alias("severity"), value(category).alias("category"), value(description).alias("description"), F.lit(remediation).alias("remediation"),
        F.lit(engine).alias("engine"), value(confidence).cast("double").alias("confidence"), F.lit(layer_ord).alias("layer_ord"), value(n).cast("long").alias("n"),
    ]


def is_text_file(path: Column) -> Column:
    return T.extension(path).isin(*TEXT_EXTENSIONS) | T.base_name(path).isin(*TEXT_NAMES)


def text_files(files: DataFrame) -> DataFrame:
    return files.where(is_text_file(F.col("path")))


def rule_hits(lo: Column, raw: Column, rules: list[Rule]) -> Column:
    """The numbers of the rules that match a text, in order; lo is raw with A-Z in lower case.

    A few rules are each tested on every text, which is the fastest for them; more are looked up by the guards that a text holds."""
    index = GuardIndex(rules)
    if len(index.words) <= DIRECT_GUARDS:
        return F.array_compact(F.array(*[F.when(condition(r, lo, raw), F.lit(i)) for i, r in enumerate(rules)]))
    return F.filter(index.candidates(lo, raw), lambda i: index.matches(i, lo, raw))


def folded(files: DataFrame) -> DataFrame:
    """Text files with raw, their bytes as text whatever they are, and lo, the same with A-Z in lower case."""
    return text_files(files).withColumn("raw", T.lossy_text(F.col("content"))).withColumn("lo", T.fold_ascii(F.col("raw")))


def signature_hits(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(bundle_id, path, rule_ord): one row for each rule that matches a text file's bytes."""
    return folded(files).select("bundle_id", "path", F.explode(rule_hits(F.col("lo"), F.col("raw"), rules)).alias("rule_ord"))


def signature_findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    pick = lambda names: F.get(constant(names, "array<string>"), F.col("rule_ord"))
    texts = pick([r.severity for r in rules]), pick([r.category for r in rules]), pick([r.description for r in rules])
    return signature_hits(files, rules).select(*finding(None, *texts, REMEDIATION, "yara", SIGNATURE_CONFIDENCE, 0, F.col("rule_ord")))


def entropies(content: bytes | pa.Buffer | None) -> list[float]:
    """Shannon entropy in bits of each chunk of CHUNK_BYTES bytes that has CHUNK_LEAST bytes or more."""
    out = []
    data = np.frombuffer(content or b"", np.uint8)
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at : at + CHUNK_BYTES]
        if len(chunk) >= CHUNK_LEAST:
            p = np.bincount(chunk, minlength=256) / len(chunk)
            p = p[p > 0]
            out.append(float(-(p * np.log2(p)).sum()))
    return out


def entropy_chunks(files: DataFrame) -> DataFrame:
    """(bundle_id, path, chunk, entropy). A histogram of bytes in each chunk is made in Arrow batches: as rows, every byte would be shuffled."""
    schema = "bundle_id string, path string, entropies array<double>"
    rows = text_files(files).where(F.col("text").isNotNull()).select("bundle_id", "path", "content")
    made = map_batches(rows, lambda b, p, c: {"bundle_id": b, "path": p, "entropies": [entropies(x) for x in c]}, schema)
    return made.select("bundle_id", "path", F.posexplode("entropies").alias("chunk", "entropy"))


def entropy_findings(files: DataFrame) -> DataFrame:
    high = entropy_chunks(files).where(F.col("entropy") > MAX_ENTROPY).groupBy("bundle_id", "path").agg(F.min_by("entropy", "chunk").alias("entropy"))
    return high.select(*finding(None, *ENTROPY_FINDING[:2], F.format_string(ENTROPY_FINDING[2], "entropy"), *ENTROPY_FINDING[3:], 0))


def marks(text: Column) -> Column:
    """The lines of a text that hold either mark, as structs (line, zero_width, rtl); only texts that hold one are cut into lines."""
    counted = F.transform(
        T.lines(text),
        lambda line, i: F.struct((i + 1).alias("line"), T.count_of(line, T.ZERO_WIDTH).alias("zero_width"), line.contains(T.RTL_OVERRIDE).alias("rtl")),
    )
    held = F.filter(counted, lambda x: (x["zero_width"] > 0) | x["rtl"])
    return F.when(holds_any(text, T.ZERO_WIDTH + T.RTL_OVERRIDE), held)


def marked_lines(files: DataFrame) -> DataFrame:
    """(bundle_id, path, line, zero_width, rtl) of lines with either mark."""
    rows = text_files(files).select("bundle_id", "path", F.explode(marks(F.col("text"))).alias("m"))
    return rows.select("bundle_id", "path", "m.*")


def unicode_findings(files: DataFrame) -> DataFrame:
    rows, line = marked_lines(files), F.col("line")
    zero = finding(line, *ZERO_WIDTH_FINDING[:2], F.format_string(ZERO_WIDTH_FINDING[2], "zero_width"), *ZERO_WIDTH_FINDING[3:], line * 2)
    rtl = finding(line, *RTL_FINDING, line * 2 + 1)
    return rows.where("zero_width > 0").select(*zero).unionByName(rows.where("rtl").select(*rtl))


def call_sites(files: DataFrame) -> DataFrame:
    """(bundle_id, path, seq, line, callee) of calls in Python files, valid or not (see call_parser.py)."""
    rows = files.where((T.extension(F.col("path")) == "py") & F.col("text").isNotNull()).select("bundle_id", "path", "text")

    def run(bundles: list, paths: list, texts: list) -> dict:
        calls = [[{"seq": i, "line": line, "callee": callee} for i, (line, callee) in enumerate(python_calls(t))] for t in texts]
        return {"bundle_id": bundles, "path": paths, "calls": calls}

    made = map_batches(rows, run, "bundle_id string, path string, calls array<struct<seq: int, line: int, callee: string>>")
    return made.select("bundle_id", "path", F.explode("calls").alias("c")).select("bundle_id", "path", "c.*")


def call_table() -> Column:
    """CALLS and ATTRIBUTES as one constant array."""
    listed = [(*row, 0.9, False) for row in CALLS] + [(*row, 0.8, True) for row in ATTRIBUTES]
    names = ("at", "pattern", "severity", "category", "description", "confidence", "is_start")
    schema = "array<struct<at: int, pattern: string, severity: string, category: string, description: string, confidence: double, is_start: boolean>>"
    return constant([dict(zip(names, (i, *row))) for i, row in enumerate(listed)], schema)


def call_hits(callee: Column) -> Column:
    """The entries of call_table() that a callee meets."""
    return F.filter(call_table(), lambda t: F.when(t["is_start"], callee.startswith(t["pattern"])).otherwise(callee.endswith(t["pattern"])))


CALL_REMEDIATION = "Avoid the call, or check what goes into it"


def call_findings(files: DataFrame) -> DataFrame:
    hits = call_sites(files).withColumn("hit", F.explode(call_hits(F.col("callee"))))
    said = F.col("hit.severity"), F.col("hit.category"), F.col("hit.description"), CALL_REMEDIATION
    made = hits.select(*finding(F.col("line"), *said, "ast", 0.0, 3, F.col("seq") * 100 + F.col("hit.at")), F.col("hit.confidence").alias("found"))
    return made.withColumn("confidence", F.col("found")).drop("found")


MEASURED = "bundle_id string, path string, hits array<int>, marks array<struct<line: int, zero_width: int, rtl: boolean>>, entropy double, calls array<struct<seq: int, line: int, callee: string>>"


def measured(files: DataFrame, with_calls: bool, rules: list[Rule]) -> DataFrame:
    """MEASURED: what every detector sees in a text file, from one look at it. entropy is that of the first chunk above MAX_ENTROPY."""
    rows = folded(files)
    is_program = (T.extension(F.col("path")) == "py") & F.lit(with_calls)
    seen = rows.select(
        "bundle_id", "path", rule_hits(F.col("lo"), F.col("raw"), rules).alias("hits"), marks(F.col("text")).alias("marks"),
        F.when(F.col("text").isNotNull(), F.col("content")).alias("content"), is_program.alias("is_program"),
    )
    arrow = to_arrow_schema(_parse_datatype_string(MEASURED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            contents, programs = [c.as_buffer() if c.is_valid else None for c in part.column("content")], part.column("is_program").to_pylist()  # no copies
            high = [next((e for e in entropies(c) if e > MAX_ENTROPY), None) for c in contents]
            calls = [
                [{"seq": i, "line": line, "callee": callee} for i, (line, callee) in enumerate(python_calls(c.to_pybytes().decode()))] if p and c is not None else []
                for c, p in zip(contents, programs)
            ]
            kept = [part.column(name).cast(arrow.field(name).type) for name in ("bundle_id", "path", "hits", "marks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(high, pa.float64()), pa.array(calls, arrow.field("calls").type)], schema=arrow)

    return seen.mapInArrow(run, MEASURED)


def static_findings(files: DataFrame, with_calls: bool = True, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of all static detectors, in the order signatures, entropy, marks, calls. Each file is read once for all of them."""

    def made(*args: object) -> Column:
        return F.struct(*finding(*args)[2:])

    listed = constant([{"severity": r.severity, "category": r.category, "description": r.description} for r in rules], "array<struct<severity: string, category: string, description: string>>")

    def of_rule(i: Column) -> Column:
        rule = F.get(listed, i)
        return made(None, rule["severity"], rule["category"], rule["description"], REMEDIATION, "yara", SIGNATURE_CONFIDENCE, 0, i)

    def of_line(m: Column) -> Column:
        zero = made(m["line"], *ZERO_WIDTH_FINDING[:2], F.format_string(ZERO_WIDTH_FINDING[2], m["zero_width"]), *ZERO_WIDTH_FINDING[3:], m["line"] * 2)
        rtl = made(m["line"], *RTL_FINDING, m["line"] * 2 + 1)
        return F.array_compact(F.array(F.when(m["zero_width"] > 0, zero), F.when(m["rtl"], rtl)))

    def of_call(c: Column) -> Column:
        def one(t: Column) -> Column:
            confidence = t["confidence"]
            return made(c["line"], t["severity"], t["category"], t["description"], CALL_REMEDIATION, "ast", confidence, 3, c["seq"] * 100 + t["at"])

        return F.transform(call_hits(c["callee"]), one)

    entropy = made(None, *ENTROPY_FINDING[:2], F.format_string(ENTROPY_FINDING[2], "entropy"), *ENTROPY_FINDING[3:], 0)
    none = lambda a: F.coalesce(a, F.array())
    all_of = F.concat(
        F.transform("hits", of_rule),
        F.array_compact(F.array(F.when(F.col("entropy").isNotNull(), entropy))),
        none(F.flatten(F.transform("marks", of_line))),
        F.flatten(F.transform("calls", of_call)),
    )
    rows = measured(files, with_calls, rules).select("bundle_id", "path", F.explode(all_of).alias("f"))
    return rows.select("bundle_id", "path", "f.*").select(*FINDING)
