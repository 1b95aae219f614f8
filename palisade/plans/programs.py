"""Programs with known calls, made from the given documents, with errors between their statements.

A seeded generator writes statements as trees of expressions and notes each call where it writes it, so what a
parser should find follows from the generator and from nothing that parses. $ stands for a word of the document; a document's
program is a choice of statements by its number, with a broken line before some of them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.rules import sql_string
from palisade.session import spread

STATEMENTS, PER_PROGRAM, SEED = 48, 6, 23

#: Lines that are no Python, or begin what never ends; none holds a call.
BROKEN = [
    "def lost(:", "x = = 3", "if (", "value = [1, 2", "'no end", 'text = f"{name', "else else", "}) ]", "class :", "for in :", "a b c", "return )", '"""no end', "print '%s' % name", "?!$", "lambda", "while x = (1:", "@", "import", "\\",
]


class Writer:
    """Text with the places of the calls in it, outer calls before inner ones."""

    def __init__(self, rng: random.Random):
        self.rng, self.text, self.calls = rng, "", []

    def put(self, *parts: str) -> Writer:
        self.text += "".join(parts)
        return self

    def name(self) -> str:
        return self.rng.choice(["load", "run", "os.system", "eval", "subprocess.run", "os.environ.get", "self.x", "item", "a_$", "$.read", "mod.$.go", "retrieval"])

    def call(self, depth: int) -> None:
        """A call, of a name or of what some other expression gives."""
        call = [len(self.text), None]
        self.calls.append(call)
        kind = self.rng.randrange(7)
        if depth > 0 and kind == 0:
            self.call(depth - 1)
        elif depth > 0 and kind == 1:
            self.put(self.rng.choice(["table", "$"]), "[")
            self.expression(depth - 1)
            self.put("]", self.rng.choice(["", ".go"]))
        elif depth > 0 and kind == 2:
            self.call(depth - 1)
            self.put(".then")
        elif kind == 3:
            self.put(self.rng.choice(["', '.join", '"a(b".format', "b'x'.decode", "'''three (quotes)'''.strip"]))
        else:
            self.put(self.name())
        call[1] = len(self.text)
        self.put(self.rng.choice(["(", "(", "(", "(\n    ", "( # not(this)\n    "]))
        for i, start in enumerate(sorted(self.rng.sample(["", "*", "key="], self.rng.randint(0, 2)))):
            self.put(", " * (i > 0), start)
            self.expression(depth - 1)
        self.put(")")

    def expression(self, depth: int) -> None:
        kind = self.rng.randrange(12) if depth > 0 else 11
        if kind < 5:
            self.call(depth)
        elif kind == 5:
            self.expression(depth - 1)
            self.put(self.rng.choice([" + ", " and ", " not in ", " == ", " if ok else "]))
            self.expression(depth - 1)
        elif kind == 6:
            self.put("[")
            self.expression(depth - 1)
            self.put(" for y in ")
            self.call(depth - 1)
            self.put("]")
        elif kind == 7:
            self.put("{'k': ")
            self.expression(depth - 1)
            self.put("}['k']")
        elif kind == 8:
            self.put("(lambda z: ")
            self.expression(depth - 1)
            self.put(")")
        elif kind == 9:
            self.put('f"$ {{x(y)}} {')
            self.call(0)
            self.put('!r:>{', "width", '}} end"')
        elif kind == 10:
            self.put("(", "$, ")
            self.expression(depth - 1)
            self.put(")")
        else:
            self.put(self.rng.choice(["x", "$", "1.5", "'text (not) a call('", "None", "a.b[0]", "r'\\('", "...", "0x1F"]))

    def statement(self) -> None:
        kind = self.rng.randrange(8)
        if kind == 0:
            self.put("value = ")
            self.expression(3)
        elif kind == 1:
            self.put("def go_$(x=1, *rest):\n    return ")
            self.expression(3)
        elif kind == 2:
            self.put("if ")
            self.call(2)
            self.put(":\n    pass")
        elif kind == 3:
            self.put("class K$(Base):\n    made = ")
            self.call(3)
        elif kind == 4:
            self.put("with ")
            self.call(1)
            self.put(" as f: ")
            self.call(2)
        elif kind == 5:
            self.put("@")
            self.call(1)
            self.put("\ndef decorated(a: int) -> str:\n    yield ")
            self.expression(2)
        elif kind == 6:
            self.put("x = 1; ")
            self.call(2)
            self.put("  # and(a, comment)")
        else:
            self.call(3)
        self.put("\n")


def made(seed: int = SEED, n: int = STATEMENTS) -> list[tuple[str, list[tuple[int, str]]]]:
    """(text, calls (line from 0, callee)) of n statements."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = Writer(rng)
        w.statement()
        out.append((w.text, [(w.text.count("\n", 0, a), w.text[a:b]) for a, b in w.calls]))
    return out


_STATEMENT, _BREAK = f"(doc_id * 7 + k * 5) % {STATEMENTS}", f"CASE WHEN (doc_id + k) % 3 = 0 THEN (doc_id + 3 * k) % {len(BROKEN)} END"


def word_sql(engine_text: str = "doc_id") -> str:
    return f"'w' || CAST({engine_text} AS STRING)"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files (bundle_id, path, text, content): a program for each document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
    texts, broken = F.array(*[F.lit(t) for t, _ in made()]), F.array(*[F.lit(b + "\n") for b in BROKEN])
    parts = []
    for k in range(PER_PROGRAM):
        statement, error = F.expr(_STATEMENT.replace("k", str(k))), F.expr(_BREAK.replace("k", str(k)))
        parts.append(F.concat(F.coalesce(F.get(broken, error.cast("int")), F.lit("")), F.get(texts, statement.cast("int"))))
    text = F.replace(F.concat(*parts), F.lit("$"), F.expr(word_sql()))
    rows = docs.select(F.col("source").alias("bundle_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return rows.withColumn("content", F.col("text").cast("binary"))


def calls_sql() -> str:
    """CTE sites(bundle_id, path, seq, line, callee) from what the generator noted."""
    sizes = ", ".join(f"({i}, {t.count(chr(10))}, {len(c)})" for i, (t, c) in enumerate(made()))
    calls = ", ".join(f"({i}, {n}, {line}, {sql_string(callee)})" for i, (_, c) in enumerate(made()) for n, (line, callee) in enumerate(c))
    return f"""sizes(statement, n_lines, n_calls) AS (VALUES {sizes}),
noted(statement, n, line, callee) AS (VALUES {calls}),
parts AS (SELECT doc_id, source, k, {_STATEMENT} AS statement, CASE WHEN {_BREAK} IS NULL THEN 0 ELSE 1 END AS broken FROM documents, (SELECT unnest(range({PER_PROGRAM})) AS k)),
placed AS (SELECT *, coalesce(sum(n_lines + broken) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + broken AS lines_before,
  coalesce(sum(n_calls) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS calls_before FROM parts JOIN sizes USING (statement)),
sites AS (SELECT source AS bundle_id, 'p' || CAST(doc_id AS VARCHAR) || '.py' AS path, calls_before + n AS seq, lines_before + line + 1 AS line, replace(callee, '$', {word_sql()}) AS callee
  FROM placed JOIN noted USING (statement))"""
