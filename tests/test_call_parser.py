"""Calls of programs, intact and broken: against the standard library's parser, and against what a generator noted."""

import ast
import random
import sysconfig
from collections import Counter
from pathlib import Path

import pytest

from palisade.operators.call_parser import python_calls
from palisade.plans.programs import BROKEN, made

LIBRARY = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))


def test_the_standard_library():
    assert len(LIBRARY) > 100
    for path in LIBRARY:
        source = path.read_text(encoding="utf-8")
        if "\f" in source or "\r" in source:
            continue
        nodes = [n.func for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call)]
        want, got = Counter((n.lineno, ast.get_source_segment(source, n)) for n in nodes), Counter(python_calls(source))
        # The library gives a callee in brackets without them.
        assert (want - got).total() == (got - want).total() and all(callee.startswith("(") for _, callee in got - want), path


@pytest.mark.parametrize("seed", range(40))
def test_intact_programs(seed):
    for text, calls in made(seed, 10):
        source = text.replace("$", "w1")
        ast.parse(source)
        assert python_calls(source) == [(line + 1, c.replace("$", "w1")) for line, c in calls]


@pytest.mark.parametrize("seed", range(100))
def test_broken_programs(seed):
    rng, text, want = random.Random(seed), "", []
    errors = rng.sample(BROKEN, 6)
    for (statement, calls), error in zip(made(seed, 6), errors):
        text += (error + "\n") * rng.randint(0, 1)
        want += [(text.count("\n") + line + 1, c) for line, c in calls]
        text += statement
    source = text.replace("$", "w1")
    assert python_calls(source) == [(line, c.replace("$", "w1")) for line, c in want]


CASES = {
    "f(x)(y)": ["f(x)", "f"],
    "a[0](b)": ["a[0]"],
    "(a or b)(c)": ["(a or b)"],
    "x.\\\n  y(z)": ["x.\\\n  y"],
    "x . y (z)": ["x . y"],
    "1.5.hex()": ["1.5.hex"],
    "'a' 'b'.join(c)": ["'a' 'b'.join"],
    "if (a): return (b)": [],
    "def f(a=g(1)) -> h(2): pass": ["g", "h"],
    "class A(b(c)): pass": ["b"],
    "def f[T](x): pass": [],
    "async def f(x): await g(x)": ["g"],
    "match (x):\n  case Point(y) if f(y):\n    g()": ["f", "g"],
    "match(x)": ["match"],
    "case = type(x)": ["type"],
    "f'{a(1)!r} {{b(2)}} {c(3):>{d(4)}}'": ["a", "c", "d"],
    "f'{x['a'](1)}'": ["x['a']"],
    'f"""{a(\n1)}\n{b()}"""': ["a", "b"],
    "# f(x)\n'g(x)'\n'''h(\nx)'''": [],
    "print((yield))": ["print"],
    "x = [f(y) for y in g(z) if h(y)]": ["f", "g", "h"],
    "{**f(x), 'k': g()}": ["f", "g"],
    "...(x)": ["..."],
    "0xFF.bit_length()": ["0xFF.bit_length"],
    "lambda: f(x)": ["f"],
    "f(x": ["f"],
    "f)(x": [],
    "'unclosed\nf(x)": ["f"],
    "f'{unclosed\nf(x)": ["f"],
    "f(\ndef g(x):\n  h(x)": ["f", "h"],
    "": [],
    "(" * 5000: [],
    "a(" * 3000: ["a"] * 3000,
    "\0é(x)": ["é"],
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert [c for _, c in python_calls(source)] == CASES[source]
