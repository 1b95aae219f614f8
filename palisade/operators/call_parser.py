"""Calls in Python source, valid or not, by tokens and brackets.

A call is an opening bracket that follows a primary: a name, a literal, a bracketed expression, or one of these with
attributes, subscripts and calls behind it. The scan keeps for each open bracket where the primary before it began, so
the callee's text is known when its bracket opens, chained and subscripted callees included. Errors end where they do
least harm: a string without its end stops at the end of its line (a triple-quoted one at its quotes), a bracket closes
those inside it that were left open, one that closes nothing is passed over, and a line that begins with a word that
only a statement can begin with closes all brackets. What is valid around an error keeps its calls."""

from __future__ import annotations

import bisect
import keyword
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\\\r?\n|\#[^\n]*)
    |(?P<newline>\n)
    |(?P<string>(?P<prefix>[rRbBuUfFtT]{0,2})(?P<quote>\"\"\"|'''|\"|'))
    |(?P<number>(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?|0[xXoObB][\da-fA-F_]+)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\.\.\.|->|:=|!=|[<>=*/%&|^+@-]=|.)""",
    re.VERBOSE | re.DOTALL,
)
HEX = re.compile(r"0[xXoObB][\da-fA-F_]+")
CONSTANTS = {"None", "True", "False"}
WORDS = set(keyword.kwlist) - CONSTANTS
#: Words that begin statements and stand in no expression.
STATEMENTS = re.compile(r"[^\S\n]*(?:def|class|import|return|while|with|try|except|finally|raise|del|pass|break|continue|global|nonlocal|assert|elif)\b")
#: A line of a match statement: what follows `case` up to its colon is a pattern, not an expression.
MATCH, CASE = re.compile(r"match\b(?!\s*[=.,:)\]])[^\n]*:\s*(?:\#[^\n]*)?$", re.MULTILINE), re.compile(
    r"case\b(?:[^\S\n]+(?!(?:in|is|and|or|if|not)\b)[\w\"'(\[{]|(?!\s*[=.,:)\]])[^\n]*:)"
)
CLOSES = {")": "(", "]": "[", "}": "{"}


@dataclass
class Level:
    open: str  # ( [ {, or f for a formatted string, or {f for a replacement field in one
    primary: int | None  # where the primary that the bracket belongs to begins; itself, if it begins one
    declares: bool = False  # opened by the head of a def or class
    quote: str = ""  # of a formatted string


def python_calls(source: str) -> list[tuple[int, str]]:
    """(line, callee's text) of every call, outer calls before those in them, in the order of the text."""
    calls: list[tuple[int, int]] = []
    stack: list[Level] = []
    pos, size = 0, len(source)
    primary: int | None = None  # where the primary that ends here begins
    end = 0  # where it ends
    dotted = declares = pattern = False
    begins, after_string = True, False  # at the beginning of a statement; behind a string

    def fields(at: int) -> int:
        """Go on in a formatted string's text, from `at` to its end or to the beginning of a replacement field."""
        nonlocal primary, end, after_string
        top = stack[-1]
        field = top.open == "{f"  # in the format of a field
        quote = next(x.quote for x in reversed(stack) if x.open == "f")
        while at < size:
            c = source[at]
            if not field and source.startswith(quote, at):
                stack.pop()
                primary, end, after_string = top.primary, at + len(quote), True
                return end
            if c == "\n" and len(quote) == 1:
                break
            if c == "\\":
                at += 2
            elif c == "{" and not field and source.startswith("{{", at):
                at += 2
            elif c == "{":
                stack.append(Level("{f", None))
                primary = None
                return at + 1
            elif c == "}" and field:
                stack.pop()
                return fields(at + 1)
            else:
                at += 1
        unwind("f")  # the string has no end
        return at

    def unwind(kind: str) -> None:
        """Close the last level of a kind, and what stands open in it."""
        nonlocal primary
        while stack and stack.pop().open != kind:
            pass
        primary = None

    while pos < size:
        m = TOKEN.match(source, pos)
        kind, text, start, pos = m.lastgroup, m.group(), pos, m.end()
        if kind in ("prefix", "quote"):
            kind = "string"
        if kind == "space":
            continue
        if kind == "newline":
            if stack and stack[-1].open == "{f" and len(next(x.quote for x in reversed(stack) if x.open == "f")) == 1:
                unwind("f")  # a field may go on below only inside brackets of its own
            if stack and STATEMENTS.match(source, pos):
                stack.clear()
            if not stack:
                primary, dotted, declares, pattern, begins, after_string = None, False, False, False, True, False
            continue
        if begins:
            begins = False
            if MATCH.match(source, start):
                primary = None
                continue
            if CASE.match(source, start):
                pattern, primary = True, None
                continue
        if kind == "string":
            quote, prefix = m["quote"], m["prefix"].lower()
            at = primary if after_string and primary is not None else start
            dotted = False
            if len(quote) == 3 and source.find(quote, pos) < 0:
                primary, end, after_string = at, pos, True  # the string has no end: what follows is read as code
                continue
            if "f" in prefix or "t" in prefix:
                stack.append(Level("f", at, quote=quote))
                pos = fields(pos)
                continue
            while pos < size and not source.startswith(quote, pos) and not (source[pos] == "\n" and len(quote) == 1):
                pos += 2 if source[pos] == "\\" else 1
            pos = min(pos, size)
            closed = source.startswith(quote, pos)
            pos += len(quote) if closed else 0
            primary, end, after_string = at if closed else None, pos, closed
            continue
        after_string = False
        if kind == "number":
            if (h := HEX.match(source, start)) is not None:
                pos = h.end()
            primary, end, dotted = start, pos, False
        elif kind == "name":
            if dotted and primary is not None:
                end = pos
            elif text in WORDS:
                if text in ("def", "class"):
                    stack.clear()
                    declares = True
                pattern = pattern and text != "if"
                primary = None
            elif declares and not stack:
                primary = None
            else:
                primary, end = start, pos
            dotted = False
        elif text == "." and primary is not None:
            dotted = True
        elif text in ("(", "["):
            head = declares and not stack
            if primary is not None and not dotted:
                if text == "(" and not pattern and not head:
                    calls.append((primary, end))
                stack.append(Level(text, primary, head))
            else:
                stack.append(Level(text, start, head))
            primary, dotted = None, False
        elif text == "{":
            stack.append(Level(text, start))
            primary, dotted = None, False
        elif text == "}" and stack and stack[-1].open == "{f":
            stack.pop()
            pos = fields(pos)
        elif text in CLOSES:
            inner = next((i for i, x in enumerate(reversed(stack)) if x.open in (CLOSES[text], "f")), None)
            dotted = False
            if inner is None or stack[-1 - inner].open == "f":
                primary = None  # it closes nothing
                if text == "}" and inner is not None:  # but a field of a formatted string, with brackets left open in it
                    while stack[-1].open != "{f":
                        stack.pop()
                    stack.pop()
                    pos = fields(pos)
                continue
            level = stack[-1 - inner]
            del stack[-1 - inner :]
            primary, end = None if level.declares else level.primary, pos
        elif stack and stack[-1].open == "{f" and (text == ":" or text == "!" and source[pos : pos + 1] in ("r", "s", "a") and source[pos + 1 : pos + 2] in (":", "}")):
            primary, dotted = None, False
            if text == ":":
                pos = fields(pos)
            else:
                pos += 1
        else:
            primary, dotted = (start, False) if text == "..." else (None, False)
            end = pos
            if not stack and text in (":", "->"):
                declares, pattern = False, False
            elif not stack and text == ";":
                begins = True

    starts = [i for i, c in enumerate(source) if c == "\n"]
    calls.sort(key=lambda x: (x[0], -x[1]))
    return [(bisect.bisect_left(starts, a) + 1, source[a:b]) for a, b in calls]
