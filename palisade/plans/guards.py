"""Guards: which rules can match a text at all, found in one pass over it.

A pattern can match only where its guard stands, the longest text that every match of it holds. All guards make one trie, written as a pattern
that looks ahead from every place of a text and takes the longest guard that begins there; the guards that it
begins with are known from the trie. An index leads from each guard to its rules, and a rule is tested only on texts
that hold one of its guards. The pass takes time in proportion to the text, whatever the number of rules: from a place it follows one
path of the trie. Sets of code points are guards of another kind, tested by themselves."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.plans.rules import LOWER, UPPER, Rule, ascii_lower, holds_any, linear, quoted

def guard(parts: list[str]) -> str:
    return max(parts, key=len)


def regex_guard(regex: str) -> str:
    """The longest plain text that stands in every match of a regular expression; '' if there is none."""
    plain, i = [""], 0
    while i < len(regex):
        if regex[i] == "\\" and i + 1 < len(regex) and not regex[i + 1].isalnum():
            piece, i = regex[i + 1], i + 2
        elif regex[i] == "\\":
            piece, i = None, i + 2  # a class such as \d
        elif regex[i] == "[":
            piece, i = None, regex.index("]", i + 2) + 1
        elif regex[i] in ".^$|()":
            if regex[i] in "|(":
                return ""
            piece, i = None, i + 1
        else:
            piece, i = regex[i], i + 1
        times = re.match(r"[*?+]|\{\d*,?\d*\}", regex[i:])
        if times:
            i += len(times.group())
        if piece is None or times:
            plain += ["" if piece is None or times.group()[0] in "*?{" else piece, ""]
        else:
            plain[-1] += piece
    return guard(plain)


def text_guard(text: str) -> str:
    """The longest run of ASCII and of the letters À to ÿ: their lower case is one letter wherever they stand, and that of other
    letters is left to the engine's tables. A text that holds the pattern holds its guard in lower case."""
    return guard(re.split(r"[^\x00-\x7f\u00c0-\u00ff]+", text)).lower()


def guards_of(rule: Rule) -> list[str] | None:
    """The guards of a rule's patterns in lower case; None if a pattern has none, so that the rule is always tested."""
    found = [text_guard(x) for x in (*rule.literals, *rule.exact)] + [guard([p.lower() for p in chain]) for chain in rule.chains] + [regex_guard(x) for x in rule.regexes]
    return None if "" in found else found


def tests_of(rule: Rule) -> list[tuple[str, str]]:
    """(how, text) of a rule's patterns; the rule matches if one holds."""
    out = [("folded", x.lower()) if x.isascii() else ("ascii", ascii_lower(x)) for x in rule.literals] + [("raw", x) for x in rule.exact]
    for chain in rule.chains:
        parts = [p.lower() for p in chain]
        out.append(("folded", parts[0]) if len(parts) == 1 else ("regex", linear([quoted(p) for p in parts])))
    for regex in rule.regexes:
        parts = regex.split(".*")
        out.append(("regex", linear(parts) if len(parts) > 1 else f"(?d){regex}"))
    return out + ([("points", f"[{rule.points}]")] if rule.points else [])


def escaped(char: str) -> str:
    return char if char.isascii() and char.isalnum() else f"\\x{{{ord(char):x}}}"


def trie_pattern(words: list[str]) -> str:
    """A pattern for the longest of the words that begins at a place, which goes down one path of their trie."""
    trie: dict = {}
    for word in words:
        node = trie
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends = "" in node
        branches = [escaped(c) + written(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        if len(branches) == 1 and not ends:
            return branches[0]
        return f"(?>{'|'.join(branches)}){'?+' if ends else ''}"

    return written(trie)


def constant(value: list, schema: str) -> Column:
    """A constant of any size as one literal, which Spark folds before the job runs."""
    return F.from_json(F.lit(json.dumps(value)), schema)


class GuardIndex:
    """From texts to the rules that can match them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.always: list[int] = []
        owners: dict[str, set[int]] = {}
        self.points: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            if rule.points:
                self.points.setdefault(rule.points, []).append(i)
            found = guards_of(rule)
            if found is None:
                self.always.append(i)
            for g in found or ():
                owners.setdefault(g, set()).add(i)
        self.words = sorted(owners)
        # A guard that is found stands for those that it begins with.
        self.owners = {g: sorted({i for h in self.words if g.startswith(h) for i in owners[h]}) for g in self.words}

    def candidates(self, folded: Column, raw: Column) -> Column:
        """The numbers of the rules that can match, in ascending order."""
        parts = [F.array(*map(F.lit, self.always)).cast("array<int>")]
        if self.words:
            first = "".join(sorted({escaped(w[0]) for w in self.words}))
            found = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=[{first}])(?=({trie_pattern(self.words)}))"), F.lit(1)))
            names, owners = constant(self.words, "array<string>"), constant([self.owners[g] for g in self.words], "array<array<int>>")
            parts.append(F.flatten(F.transform(found, lambda g: F.get(owners, (F.array_position(names, g) - 1).cast("int")))))
        for points, numbers in self.points.items():
            parts.append(F.when(holds_any(raw, points), F.array(*map(F.lit, numbers))).otherwise(F.array().cast("array<int>")))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    def matches(self, number: Column, folded: Column, raw: Column) -> Column:
        """Whether the rule of this number matches. Patterns are data here, so that the plan doesn't grow with the rules."""
        rules = constant([[{"how": how, "text": text} for how, text in tests_of(rule)] for rule in self.rules], "array<array<struct<how: string, text: string>>>")
        tests = {
            "folded": lambda text: F.contains(folded, text),
            "raw": lambda text: F.contains(raw, text),
            "ascii": lambda text: F.contains(F.translate(raw, UPPER, LOWER), text),
            "regex": lambda text: F.rlike(folded, text),
            "points": lambda text: F.rlike(raw, text),
        }

        def holds(p: Column) -> Column:
            out = F.lit(False)
            for how, test in tests.items():
                out = F.when(p["how"] == how, test(p["text"])).otherwise(out)
            return out

        return F.exists(F.get(rules, number), holds)
