"""Findings from sandbox telemetry, which is an input table: nothing that is scanned is ever run here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.detect import FINDING

# Canary texts with what they stand for, and signs of a shell.
CANARIES = {
    "AKIA_TRAP_CANARY_AWS_KEY_8832": "AWS Credentials (~/.aws/credentials)",
    "sk-trap-canary-openai-key-998877665544": "OpenAI API Token ($OPENAI_API_KEY)",
    "ghp_trap_canary_github_token_xyz987": "GitHub Token ($GITHUB_TOKEN)",
    "CANARY_SSH_PRIVATE_KEY_TRAP_44321": "SSH Private Key (~/.ssh/id_rsa)",
}
SHELLS = ("cmd.exe", "/bin/sh", "/bin/bash", "WScript.Shell")


def telemetry_findings(telemetry: DataFrame) -> DataFrame:
    """telemetry (bundle_id, file, stdout, stderr, exit_code, timed_out, modified) to findings: leaked canaries (one
    finding that lists them), each modified file, and traces of a shell."""
    output = F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit("")))
    leaked = F.array_join(F.array_compact(F.array(*[F.when(output.contains(text), F.lit(name)) for text, name in CANARIES.items()])), ", ")
    shell = output.contains(SHELLS[0])
    for name in SHELLS[1:]:
        shell = shell | output.contains(name)
    made = lambda severity, category, description, remediation, confidence, n: F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), description.alias("description"), F.lit(remediation).alias("remediation"), F.lit(confidence).alias("confidence"), n.cast("long").alias("n")
    )
    leak = F.when(leaked != "", made("CRITICAL", "SD-03 · Data Exfiltration", F.concat(F.lit("Canary credentials in the output: "), leaked), "Revoke the keys; remove the reads", 0.98, F.lit(0)))
    writes = F.transform(F.coalesce("modified", F.array().cast("array<string>")), lambda name, i: made("CRITICAL", "SD-08 · Persistent Backdoors", F.concat(F.lit("Modified a persistence file: "), name), "Keep bundles from writing startup files", 0.95, i + 1))
    spawned = F.when(shell, made("HIGH", "SD-02 · Command Injection", F.lit("A system shell was started"), "Pass arguments without a shell", 0.92, F.size(F.coalesce("modified", F.array().cast("array<string>"))) + 1))
    rows = telemetry.select("bundle_id", F.col("file").alias("path"), F.explode(F.array_compact(F.concat(F.array(leak), writes, F.array(spawned)))).alias("f"))
    return rows.select("bundle_id", "path", F.lit(None).cast("int").alias("line"), "f.*", F.lit("sandbox").alias("engine"), F.lit(5).alias("layer_ord")).select(*FINDING)


def carry_writes(telemetry: DataFrame) -> DataFrame:
    """Telemetry as one shared home gives it: a file modified by one script is reported again for each later one."""
    from pyspark.sql import Window

    before = Window.partitionBy("bundle_id").orderBy(F.split("file", "/")).rowsBetween(Window.unboundedPreceding, 0)
    return telemetry.withColumn("modified", F.array_distinct(F.flatten(F.collect_list("modified").over(before))))
