"""License scan, quality rules and personal data against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from palisade.llm import licenses, pii, quality
from tests.llm.conftest import ROWS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def everything(spark, edge, docs):
    """Edge rows and the smallest documents; the edge rows' numbers are put out of the way of the documents'."""
    moved = edge.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    return moved.unionByName(docs.select(*moved.columns)).cache()


@pytest.fixture(scope="module")
def rows(everything):
    return [(r.doc_id, r.text) for r in everything.collect()]


def sorted_rows(found):
    return sorted(found, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


# Licenses


def slow_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places(everything, rows):
    got = licenses.license_report(everything).collect()
    assert sorted_rows([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]) == sorted_rows([(i, *slow_licenses(t)) for i, t in rows])
    assert any(r.n_base for r in got)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)


def test_licenses_of_rows_that_share_an_id(spark):
    rows = [(1, "under the MIT license"), (1, "nothing here"), (None, "CC-BY-NC"), (None, "under the mit license too"), (None, None)]
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted_rows([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]) == sorted_rows([(i, *slow_licenses(t)) for i, t in rows])


def slow_labels(text):
    """Labels and score by a plain search: votes of each diagonal, neighbours joined in order, share of words covered."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    labels, best = set(), 0.0
    for _, label, template, size, is_base in licenses.templates():
        want, diagonals = template.split(), {}
        for i in range(len(words) - licenses.GRAM + 1):
            for k in range(size - licenses.GRAM + 1):
                if words[i : i + licenses.GRAM] == want[k : k + licenses.GRAM]:
                    diagonals.setdefault(i - k, set()).add(k)
        spans, last, number = [], None, None
        for d, at in sorted(diagonals.items(), key=lambda x: (x[0] + min(x[1]), x[0])):
            covered = len({k + j for k in at for j in range(licenses.GRAM)})
            whole = len(at) == size - licenses.GRAM + 1
            if last is not None and abs(d - number) <= licenses.NEAR_DIAGONALS and d + min(at) - last <= licenses.NEAR_WORDS:
                spans[-1] = (spans[-1][0] + covered, spans[-1][1] or whole)
            else:
                spans.append((covered, whole))
            last, number = d + max(at), d
        for covered, whole in spans:
            score = min(covered, size) / size
            if (is_base and whole) or (not is_base and score >= licenses.MIN_COVERAGE):
                labels.add(label)
            if whole or not is_base:
                best = max(best, score)
    return ",".join(sorted(labels)), best


def noticed(seed):
    """Notices with words changed, put in, left out and cut short, among other words."""
    rng, out = random.Random(seed), []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            _, _, text, _, _ = rng.choice(licenses.templates())
            part = text.split()
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(part))
                part[k : k + rng.randint(0, 1)] = ["other"] * rng.randint(0, 1)
            words += ["word"] * rng.randint(0, 30) + part[: rng.randint(1, 60)]
        out.append((i, " ".join(words)))
    return out


def test_license_labels_and_scores_against_a_plain_search(spark):
    rows = noticed(5) + [(100, None), (101, "one")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: slow_labels(t) for i, t in rows}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert len({x[0] for x in want.values()}) > 5


def test_license_method_bears_inserted_and_missing_words(spark, empty):
    notice = licenses.NOTICES["bsd"][0].split()
    texts = [" ".join(["x"] * 50 + notice[:6] + ["or", "reuse"] + notice[6:9] + notice[10:] + ["y"]), " ".join(notice[:5]), " ".join(reversed(notice))]
    got = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["bsd", "", ""] and got[0].score > 0.6 and got[0].n_base == 0
    assert licenses.license_report(empty).count() == 0


# Quality rules


def slow_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_counts(everything, rows):
    got = quality.quality_report(everything).collect()
    assert sorted_rows([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == sorted_rows([(i, *slow_quality(t)) for i, t in rows])
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_quality_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.3, 0.2, 0.0], [0.25, 0.25, 0.0, 0.5]
    mean = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, mean) if a)
    got = spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_quality_rejects_strange_texts_and_keeps_prose(spark, docs):
    rng = random.Random(2)
    names = ["the", "of", "and", "to", "a", "cat", "dog", "tree", "sea", "hill", "road", "stone", "lamp", "door", "bird", "roof", "field"]
    prose = [(i, " ".join(rng.choice(names) for _ in range(200)), "en") for i in range(30)]
    junk = [(100, " ".join(f"#{k}%%$ &&{k * k}|| <<{k + 5}>>" for k in range(200)), "en")]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(100) and all(got.values())


def test_word_rule_rejects_texts_of_another_language(spark):
    """Letters alone look alike; the shares of common words do not."""
    rng = random.Random(4)
    text = lambda common: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(("cat", "dog", "tree", "sea", "hill", "road")) for _ in range(200))
    english, other = quality.COMMON_WORDS["en"], ["og", "det", "at", "har", "som", "var", "til", "av"]
    rows = [(i, text(english), "en") for i in range(40)] + [(100, text(other), "en")]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    bad = got.pop(100)
    assert not bad.kept and not bad.base_failed and bad.char_distance <= quality.MAX_CHAR_DISTANCE and bad.word_distance > quality.MAX_WORD_DISTANCE
    assert all(r.kept for r in got.values())


def slow_distance(p, q):
    total = 0.0
    for x, y in zip(p, q):
        total += sum(a * math.log2(2 * a / (a + b)) for a, b in ((x, y), (y, x)) if a) / 2
    return math.sqrt(max(total, 0.0))


def test_word_distances_and_verdicts_against_plain_python(spark, docs, sample):
    """References of an odd number of documents are exact medians, so both sides can be compared."""
    long = [(i, t, lang) for i, t, lang, _ in sample if lang == "en" and len(WORDS.findall(t or "")) >= quality.MIN_WORDS][:41]
    frame = spark.createDataFrame(long, "doc_id long, text string, lang string")
    names = quality.COMMON_WORDS["en"]
    hist = {}
    for i, t, _ in long:
        words = [w.lower() for w in WORDS.findall(t)]
        counts = [words.count(n) for n in names]
        hist[i] = [c / len(words) for c in [*counts, len(words) - sum(counts)]]
    medians = [sorted(h[k] for h in hist.values())[len(long) // 2] for k in range(len(names) + 1)]
    ref = [m / sum(medians) for m in medians]
    for r in quality.quality_report(frame).collect():
        assert abs(r.word_distance - slow_distance(hist[r.doc_id], ref)) < 1e-6
        assert r.kept == (not r.base_failed and r.char_distance <= quality.MAX_CHAR_DISTANCE and r.word_distance <= quality.MAX_WORD_DISTANCE)


def test_quality_filter_keeps_columns(edge, empty):
    left = quality.quality_filter(edge)
    assert left.columns == edge.columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and not set(ids) & {3, 4, 5, 7, 9}
    assert quality.quality_report(empty).count() == 0


# Personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"\D", "", m[0])
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b@c.de d..e@-x-.y-.z. @x.com q@x %a@b.c.d@e.f", "1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 1.2.3 99999999999.1.1.1 1.1.1.1",
    "4111-1111-1111-1111 4111111111111111 4111  1111 1111 1111 41111111111111111111 5500 0000 0000 0004", "+1 +12 +123456789 ++49 (30) 123-456.78 +1234567890123456 +4-4 20 7946 0958)",
    "\U0001f600 a@b.co éx@y.zz ٣.٤.٥.٦ 1٢.3.4.5",
]


def test_personal_data_base_spans(spark, everything, rows):
    more = [(5_000_000 + i, t) for i, t in enumerate(TRICKY)]
    frame = everything.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted_rows([(i, *[sum(s.startswith(k + ":") for s in found) for k in BASE], hashlib.sha256(",".join(found).encode()).hexdigest()) for i, found in ((i, slow_spans(t)) for i, t in rows + more)])
    got = pii.personal_data_report(frame).collect()
    assert sorted_rows([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got]) == want
    spans = {r.doc_id: r.spans.split(",") for r in got if r.doc_id}
    times = Counter(i for i, _ in rows + more)
    for i, t in rows + more:
        if i and times[i] == 1:
            assert set(slow_spans(t)) <= set(spans.get(i, []))
    assert any("secret:" in ",".join(s) for s in spans.values())


def test_personal_data_on_an_empty_table(empty, edge):
    assert pii.personal_data_report(empty).count() == 0
    assert pii.personal_data_report(edge).count() == len(ROWS)


def personal(seed, n=1500):
    """(doc_id, text, kind, start, end, is true): one candidate in each text."""
    rng, rows = random.Random(seed), []
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good, size=16):
        x = rng.choice("3456") + digits(size - 2)
        last = [c for c in "0123456789" if pii.luhn(x + c) == good]
        return x + rng.choice(last)

    makers = [
        lambda ok: ("email", rng.choice(("contact ", "mail me at ", "see ")) if ok else rng.choice(("syntax ", "example ", "run ")), f"{rng.choice(('ann', 'bo.li'))}{digits(2)}" + (rng.choice(("@", " [at] ", "(at)")) + rng.choice(("mail", "post")) + ".example.com" if ok else "@" + rng.choice(("localhost", "host", "v2")))),
        lambda ok: ("ip", rng.choice(("host ", "server ", "from ")) if ok else rng.choice(("version ", "release ", "see ")), ".".join(str(rng.randint(1, 255)) for _ in range(4)) if ok else f"{rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(0, 40)}.{rng.randint(256, 4000)}"),
        lambda ok: ("card", rng.choice(("card ", "paid with ", "visa ")) if ok else rng.choice(("order ", "isbn ", "number ")), card(ok, rng.choice((15, 16)) if ok else rng.choice((13, 14, 16, 17)))),
        lambda ok: ("phone", rng.choice(("call ", "tel ", "or ")) if ok else rng.choice(("date ", "on ", "since ")), rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+1 ({digits(3)}) 555-{digits(4)}")) if ok else f"{rng.choice((19, 20))}{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}"),
        lambda ok: ("secret", rng.choice(("token = ", "api_key: ", "password=")), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40)))) if ok else rng.choice(("required", "string", "your_password", "optional", "hidden", "none"))),
    ]
    for i in range(n):
        ok = rng.random() < 0.5
        kind, cue, span = rng.choice(makers)(ok)
        lead = " ".join(rng.choice(("some", "words", "in", "front")) for _ in range(9)) + " " + cue
        rows.append((i, f"{lead}{span} and words behind", kind, len(lead), len(lead) + len(span), ok))
    return rows


def test_personal_data_of_every_kind_is_found_and_false_candidates_are_refused(spark):
    rows = personal(1)
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.personal_data_report(frame).collect()}
    seen = {i: {(k, a, b) for k, a, b in pii.candidates(t, pii.base_spans(t))} for i, t, *_ in rows}
    for kind in pii.KINDS:
        of = [r for r in rows if r[2] == kind]
        caught = [f"{kind}:{a}:{b}" in got[i] for i, _, _, a, b, ok in of if ok]
        false = [(i, a, b) for i, _, _, a, b, ok in of if not ok and (pii.KINDS.index(kind), a, b) in seen[i]]
        refused = [f"{kind}:{a}:{b}" not in got[i] for i, a, b in false]
        assert sum(caught) >= 0.9 * len(caught), (kind, sum(caught), len(caught))
        assert len(false) > 50 and sum(refused) >= 0.9 * len(refused), (kind, sum(refused), len(refused))


def test_em_probabilities_follow_the_truth(spark):
    rows = personal(2)
    counts, truth = Counter(), Counter()
    for _, text, kind, a, b, ok in rows:
        k, base = pii.KINDS.index(kind), pii.base_spans(text)
        if (k, a, b) in pii.candidates(text, base):
            v = (k, pii.votes(text, k, a, b, (k, a, b) in base))
            counts[v] += 1
            truth[v] += ok
    right = 0
    for k in range(len(pii.KINDS)):
        prob, _ = pii.reliabilities({v: n for (x, v), n in counts.items() if x == k})
        right += sum(truth[k, v] if p >= 0.5 else counts[k, v] - truth[k, v] for v, p in prob.items())
    assert right >= 0.9 * counts.total()


def test_em_finds_the_good_labeler():
    """One labeler follows the truth nine times in ten, one is a coin, one votes seldom but rightly."""
    rng, counts, truth = random.Random(7), Counter(), Counter()
    for _ in range(4000):
        real = rng.random() < 0.5
        a = real if rng.random() < 0.9 else not real
        votes = ("y" if a else "n") + rng.choice("yn") + (("y" if real else "n") if rng.random() < 0.5 else "-")
        counts[votes] += 1
        truth[votes] += real
    prob, chances = pii.reliabilities(dict(counts))
    wrong = sum(abs(truth[v] / counts[v] - prob[v]) * counts[v] for v in counts) / 4000
    assert wrong < 0.1 and chances[0, 0, 0] > 0.8 > chances[1, 0, 0]
