"""Rule packs and the guard index."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import detect, reports
from palisade.plans import guards, packs
from palisade.plans.planted import planted_files
from palisade.plans.rules import RULES, Rule, condition, holds_any

SF = "/root/testdata/sf0.001"


def test_round_trip():
    assert packs.parse(packs.written(RULES)) == RULES
    odd = [Rule("A", 'quo"ted \\ back', "LOW", "tab\there", ('a"b\\c\n', "ünï"), (("a.b", "c/d"),), ("x\\d{3}y",), "é‮", ("Case",))]
    again = packs.parse(packs.written(odd))
    assert again[0].literals == odd[0].literals and again[0].exact == ("Case",) and again[0].chains == odd[0].chains and again[0].points == odd[0].points


PACK = r"""
// a comment, and /* another */
rule Own_One { meta: severity = "odd" author = "me"
  strings: $a = "Plain Text" nocase   $b = "AsIs"  $c = /begin.*\d+.*end/i  $d = /ab+.*c{2}d/i
  condition: any of them }
rule Own_Two
{
    meta:
        category = "Own · Class"
        severity = "low"
    strings:
        $only = /\xc3\xa9|\xe2\x82\xac/  // é or €
    condition:
        $only
}
"""
TEXTS = {"plain TEXT": 1, "asis": 0, "x AsIs": 1, "begin a 5 the END": 1, "begin\n5 end": 0, "xABBB .. ccd": 1, "ab cd": 0, "café": 2, "5 €": 2, "CAFÉ": 0, "nothing": 0}


def test_own_pack(spark, tmp_path):
    path = tmp_path / "own.rules"
    path.write_text(PACK)
    rules = packs.load(spark, str(path))
    assert [(r.rule_id, r.category, r.severity) for r in rules] == [("Own_One", "Own_One", "MEDIUM"), ("Own_Two", "Own · Class", "LOW")]
    files = spark.createDataFrame([("b", f"{i}.md", t, t.encode()) for i, t in enumerate(TEXTS)], "bundle_id string, path string, text string, content binary")
    hits = {(list(TEXTS)[int(r.path[:-3])], r.rule_ord + 1) for r in detect.signature_hits(files, rules).collect()}
    assert hits == {(t, n) for t, n in TEXTS.items() if n}
    results, found, _ = reports.scan(files, rule_packs=(packs.CORE, str(path)))
    assert {r.category for r in found.collect()} == {"Own_One", "Own · Class"} and results.first().n_findings == 6
    with pytest.raises(packs.PackError, match="two rules"):
        packs.load(spark, str(path), str(path))


@pytest.mark.parametrize(
    ("pattern", "said"),
    [("/a(b|c)/i", "linear"), ("/a+b+c/i", "inside a piece"), ("/ab*c/i", "lengths"), ("/a?/i", "lengths"), ("/a{2,}b/i", "lengths"), ("/abc/", "needs i"), ("/.*/i", "everything"), ("/a/m", "flags"), ("/a\\b/i", "not known"), ("/\\xff/", "code point"), ('""', "everything"), ("/é/i", "ASCII")],
)
def test_refused(pattern, said):
    with pytest.raises(packs.PackError, match=said):
        packs.parse(f"rule R {{ strings: $a = {pattern} condition: any of them }}")


@pytest.mark.parametrize("text", ["rule", "rule A {", "rule A { strings: $a = \"x\" condition: all of them }", "rule A { condition: any of them }", "what ?", 'rule A { strings: $a = "x" nocase $b = "y" condition: $a }'])
def test_not_readable(text):
    with pytest.raises(packs.PackError):
        packs.parse(text)


def test_regex_guards():
    assert [guards.regex_guard(x) for x in ("repeat.*\\d.*times", "\\\\x[0-9a-f]{2}", "if.*time.*>.*\\d", "a|b", "ab*c", "(x)", "[abc]", "ab+cd")] == ["repeat", "\\x", "time", "", "a", "", "", "cd"]


def test_trie_finds_the_longest_guard_at_every_place(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc.( ") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"tool", "print", "eval("})
    texts = ["".join(rng.choice("abc.( x") for _ in range(200)) for _ in range(40)] + ["printool(eval(", ""]
    found = F.regexp_extract_all("t", F.lit(f"(?=({guards.trie_pattern(words)}))"), F.lit(1))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", found.alias("found")).collect():
        want = [max(here, key=len) for i in range(len(r.t)) if (here := [w for w in words if r.t.startswith(w, i)])]
        assert r.found == want


def many_rules(n):
    """The built-in rules and n of every kind."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    return [*RULES, *[Rule(f"R{i}", "c", "LOW", "d", (word(), word()), ((word(), word()),), (f"{word()}.*\\d",), "", (word().title(),)) for i in range(n)]]


def test_the_index_gives_what_all_conditions_give(spark, monkeypatch):
    rules = many_rules(100)
    rng, files = random.Random(9), planted_files(spark, SF).select("bundle_id", "path", "text", "content")
    rows = []
    for i in range(60):
        parts = [rng.choice([x for r in rng.sample(rules, 3) for x in (*r.literals, *r.exact, *[" ".join(c) for c in r.chains], "7", "\n", r.points or "q")]) for _ in range(8)]
        text = "".join(parts)
        rows.append(("own", f"{i}.md", text, text.encode()))
    files = files.unionByName(spark.createDataFrame(rows, files.schema))
    for chosen in (rules, RULES):
        monkeypatch.setattr(detect, "DIRECT_GUARDS", 0)
        got = {(r.path, r.rule_ord) for r in detect.signature_hits(files, chosen).collect()}
        lo, raw = detect.T.fold_ascii(F.col("text")), F.col("text")
        texts = detect.text_files(files)
        want = {(r.path, i) for i, rule in enumerate(chosen) for r in texts.where(condition(rule, lo, raw)).select("path").collect()} if chosen is RULES else None
        monkeypatch.setattr(detect, "DIRECT_GUARDS", 10**6)
        direct = {(r.path, r.rule_ord) for r in detect.signature_hits(files, chosen).collect()}
        assert got == direct and len(got) > 80 and want in (None, got)


def test_letters_beyond_ascii_stay_in_guards(spark, monkeypatch):
    rules = [Rule(f"R{i}", "c", "LOW", "d", literals) for i, literals in enumerate([("räan",), ("Óntion",), ("σanΣ",), ("ł-er",), ("ÄÖ", "kKer")])]
    rules += [Rule("X", "c", "LOW", "d", (), (), (), "", ("ÀéThß",)), Rule("Y", "c", "LOW", "d", (), (), (), "", ("İng",))]
    assert [guards.guards_of(r) for r in rules[:2]] == [["räan"], ["óntion"]]
    words = ["räan", "RÄan", "RäAN", "óntion", "ÓnTION", "σANΣ", "ΣanΣ", "σanς", "Ł-ER", "ł-ER", "äö", "ÄÖ", "ker", "KKer", "kKer", "ÀéThß", "àéthß", "ÀÉTHSS", "İng", "i̇ng", "ing", "Ång"]
    rows = [("b", f"{i}{end}.md", start + w + end, (start + w + end).encode()) for i, w in enumerate(words) for start, end in (("", ""), ("x", "ä"), ("Σ", "Σ"))]
    files = spark.createDataFrame(rows, "bundle_id string, path string, text string, content binary")
    got = []
    for most in (0, 10**6):
        monkeypatch.setattr(detect, "DIRECT_GUARDS", most)
        got.append({(r.path, r.rule_ord) for r in detect.signature_hits(files, rules).collect()})
    assert got[0] == got[1] and {i for _, i in got[0]} == set(range(len(rules)))


def test_code_points_are_searched_without_a_pattern(spark):
    points = next(r.points for r in RULES if r.rule_id == "SD10_Homoglyph_Substitution")
    texts = [*points, "x", "", "а" * 3, "xСx", "б", None, "д" + points[0]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", holds_any(F.col("t"), points).alias("is_held"))
    assert [r.is_held for r in got.collect()] == [None if t is None else any(c in t for c in points) for t in texts]
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString().upper()
