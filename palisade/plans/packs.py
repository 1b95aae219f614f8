"""Rule packs: rules in text files, read into the same rows as the built-in ones, and written from them.

    rule Name {
        meta:      category = "..."  severity = "HIGH"  description = "..."
        strings:   $a = "text" nocase    $b = /first.*second/i    $c = /\\xd0\\xb0|\\xd0\\x90/
        condition: any of them
    }

The condition is `any of them`, or the only pattern's name. Comments begin with //. A string without nocase is matched as it stands. A pattern /.../i is a
chain of pieces with .* between them on one line; a piece is made of characters, classes and fixed repeats, so all its
matches have one length and the earliest place of each piece decides: the text is read once for each piece, in time
proportional to its length. What would break this (groups, alternatives, open repeats inside a piece) is refused by
name. At the border of a piece X+ means X, since .* takes the rest. A pattern without i is a choice of code points by
their UTF-8 bytes."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from palisade.plans.rules import RULES, Rule

#: The name of the rules that are built in.
CORE = "core"
TOKENS = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*")|(?P<regex>/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*)|(?P<name>\$?\w+)|(?P<sign>[{}:=])""",
    re.VERBOSE | re.DOTALL,
)
ELEMENT = re.compile(r"(?P<class>\\[dDwWsS]|\[\^?\]?(?:\\.|[^\]\\])*\]|\.)|(?P<escape>\\x[0-9a-fA-F]{2}|\\.)|(?P<plain>[^\\\[\]().|?*+{}^$])")
REPEAT = re.compile(r"[*+?]|\{(\d+)(,\d*)?\}")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


class PackError(ValueError):
    """What a pack says can't be read, or not in linear time; with the rule and the pattern."""


@dataclass
class _Tokens:
    items: list[tuple[str, str, int]]  # kind, text, line
    at: int = 0

    def peek(self) -> tuple[str, str, int]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "the end", self.items[-1][2] if self.items else 1)

    def take(self, *wanted: str) -> str:
        kind, text, line = self.peek()
        if kind not in wanted and text not in wanted:
            raise PackError(f"line {line}: {' or '.join(wanted)} expected, not {text}")
        self.at += 1
        return text


def tokens_of(text: str) -> _Tokens:
    items, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if m is None:
            raise PackError(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r} can't be read")
        if m.lastgroup != "space":
            items.append((m.lastgroup, m.group(), text.count("\n", 0, at) + 1))
        at = m.end()
    return _Tokens(items)


ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def string_of(quoted: str) -> str:
    """The text of a string in quotes; \\xHH are UTF-8 bytes."""
    out = bytearray()
    for m in re.finditer(r"\\x([0-9a-fA-F]{2})|\\(.)|([^\\]+)", quoted[1:-1], re.DOTALL):
        out += bytes([int(m[1], 16)]) if m[1] else ESCAPES.get(m[2], m[2]).encode() if m[2] else m[3].encode()
    try:
        return out.decode()
    except UnicodeDecodeError:
        raise PackError(f"{quoted} isn't UTF-8") from None


def points_of(regex: str) -> str:
    """The code points that a choice of UTF-8 byte sequences stands for."""
    out = ""
    for part in regex.split("|"):
        if not re.fullmatch(r"(\\x[0-9a-fA-F]{2})+", part):
            raise PackError(f"/{regex}/ needs i, unless it is a choice of bytes")
        char = bytes.fromhex(part.replace("\\x", "")).decode("utf-8", "replace")
        if len(char) != 1 or char == "�":
            raise PackError(f"{part} is no single code point")
        out += char
    return out


def pieces_of(regex: str) -> list[tuple[str, str | None]]:
    """(pattern, plain text or null) of the pieces of a chain, each of one length."""
    pieces: list[list[tuple[str, str | None, bool]]] = [[]]  # (pattern, character or null, whether X+)
    at = 0
    while at < len(regex):
        m = ELEMENT.match(regex, at)
        if m is None:
            raise PackError(f"/{regex}/: {regex[at]!r} can't be matched in linear time here")
        at = m.end()
        times = REPEAT.match(regex, at)
        element, char = m.group(), None
        if m["plain"]:
            char = m["plain"]
        elif m["escape"]:
            char = chr(int(element[2:], 16)) if element.startswith("\\x") else ESCAPES.get(element[1], element[1])
            if element[1].isalnum() and element[1] not in ESCAPES and element[1] != "x":
                raise PackError(f"/{regex}/: {element} is not known")
        if times is None:
            pieces[-1].append((element, char, False))
            continue
        at = times.end()
        if regex[at : at + 1] in ("?", "+"):
            raise PackError(f"/{regex}/: {times.group()}{regex[at]} is not known")
        if element == "." and times.group() == "*":
            pieces.append([])
        elif times.group() == "+":
            pieces[-1].append((element, char, True))
        elif times[1] and not times[2]:
            pieces[-1].append((element + times.group(), char if char is None else char * int(times[1]), False))
        else:
            raise PackError(f"/{regex}/: {times.group()} makes matches of different lengths")
    out = []
    for piece in pieces:
        for i, (element, _, more) in enumerate(piece):
            if more and 0 < i < len(piece) - 1:
                raise PackError(f"/{regex}/: {element}+ stands inside a piece, where it can't be matched in linear time")
        if piece:  # .* at an end, or twice, says nothing
            plain = None if any(c is None for _, c, _ in piece) else "".join(c for _, c, _ in piece)
            out.append(("".join(e for e, _, _ in piece), plain))
    if not out:
        raise PackError(f"/{regex}/ matches everything")
    return out


def rule_of(tokens: _Tokens) -> Rule:
    tokens.take("rule")
    name = tokens.take("name")
    tokens.take("{")
    meta: dict[str, str] = {}
    literals, exact, chains, regexes, points, names = [], [], [], [], "", []
    while tokens.peek()[1] != "condition":
        section = tokens.take("meta", "strings")
        tokens.take(":")
        while tokens.items[tokens.at + 1 : tokens.at + 2] and tokens.items[tokens.at + 1][1] == "=":
            key = tokens.take("name")
            tokens.take("=")
            if section == "meta":
                meta[key] = string_of(tokens.take("text"))
                continue
            names.append(key)
            kind, value, _ = tokens.peek()
            tokens.take("text", "regex")
            if kind == "text":
                fold = tokens.peek()[1] == "nocase"
                tokens.at += fold
                (literals if fold else exact).append(string_of(value))
                continue
            regex, flags = value[1:].rsplit("/", 1)
            if flags not in ("", "i"):
                raise PackError(f"{name}: the flags {flags} are not known")
            if flags == "":
                points += points_of(regex)
                continue
            if not regex.isascii():
                raise PackError(f"{name}: /{regex}/ holds letters beyond ASCII, which i doesn't fold")
            pieces = pieces_of(regex)
            if all(plain is not None for _, plain in pieces):
                chains.append(tuple(plain for _, plain in pieces))
            else:
                regexes.append(".*".join(p.lower() if plain is not None else p for p, plain in pieces))
    tokens.take("condition")
    tokens.take(":")
    said = []
    while tokens.peek()[1] != "}":
        said.append(tokens.take("name"))
    tokens.take("}")
    if said != ["any", "of", "them"] and not (len(names) == 1 and said == names):
        raise PackError(f"{name}: the condition {' '.join(said)} is not known")
    if not names or "" in literals or "" in exact:
        raise PackError(f"{name} matches everything, or nothing")
    severity = meta.get("severity", "MEDIUM").upper()
    return Rule(
        name, meta.get("category", name), severity if severity in SEVERITIES else "MEDIUM", meta.get("description", name),
        tuple(literals), tuple(chains), tuple(regexes), points, tuple(exact),
    )


def parse(text: str) -> list[Rule]:
    """The rules of a pack, in its order."""
    tokens, out = tokens_of(text), []
    while tokens.peek()[0] != "end":
        out.append(rule_of(tokens))
    names = [r.rule_id for r in out]
    if len(set(names)) < len(names):
        raise PackError(f"two rules are named {next(n for n in names if names.count(n) > 1)}")
    return out


def quoted(text: str) -> str:
    return '"' + "".join("\\" + c if c in '"\\' else f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c for c in text) + '"'


def written(rules: list[Rule]) -> str:
    """Rules as a pack; parse() gives the same rules again."""
    plain = lambda p: "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in p)
    out = []
    for rule in rules:
        patterns = [f"{quoted(x)} nocase" for x in rule.literals] + [quoted(x) for x in rule.exact] + [f"/{'.*'.join(map(plain, chain))}/i" for chain in rule.chains] + [f"/{x}/i" for x in rule.regexes]
        patterns += ["/" + "|".join("".join(f"\\x{b:02x}" for b in c.encode()) for c in rule.points) + "/"] if rule.points else []
        meta = "".join(f"        {k} = {quoted(v)}\n" for k, v in (("description", rule.description), ("category", rule.category), ("severity", rule.severity)))
        strings = "".join(f"        $p{i} = {p}\n" for i, p in enumerate(patterns))
        out.append(f"rule {rule.rule_id}\n{{\n    meta:\n{meta}    strings:\n{strings}    condition:\n        any of them\n}}\n")
    return "\n".join(out)


def load(spark: SparkSession, *packs: str) -> list[Rule]:
    """The rules of packs: CORE, or the path of a file that Spark can read (a pack is small; it is read in the driver)."""
    rules: list[Rule] = []
    for pack in packs:
        rules += RULES if pack == CORE else parse("\n".join(r.value for r in spark.read.option("wholetext", "true").text(pack).collect()))
    names = [r.rule_id for r in rules]
    if len(set(names)) < len(names):
        raise PackError(f"two rules are named {next(n for n in names if names.count(n) > 1)}")
    return rules


def many(n: int, seed: int = 31) -> list[Rule]:
    """n seeded rules of every kind of pattern, made of syllables of the given documents: for checks of large packs."""
    rng = random.Random(seed)
    syllables = ["tion", "ment", "que", "ch", "an", "er", "le", "ent", "ing", "th", "ou", "ra", "ci", "ón", "sch", "pa", "ve", "ä"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    plain = lambda k: "".join(rng.choice(syllables[:12]) for _ in range(k))
    rules = []
    for i in range(n):
        kind = i % 4
        rules.append(Rule(
            f"MANY_{i:03d}", f"Class {i % 7}", SEVERITIES[i % 5], "A seeded rule", literals=(word(3), word(4)) if kind < 2 else (), chains=((plain(4), plain(3)),) if kind in (1, 2) else (),
            regexes=(f"{plain(3)}.*[0-9]",) if kind == 3 else (), exact=(word(3).capitalize(),) if kind == 0 else (),
        ))
    return rules
