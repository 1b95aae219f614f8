"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities, and a
span classifier trained on the resulting probabilities decides which spans are added.

Candidates come from loose patterns of each kind, wide enough to hold false ones beside true ones: addresses without a
dot or with the at sign spelt out, four numbers of any size, long digit runs whether or not their check digit holds,
telephone-like groups and dates, and values assigned to a name like password. Seven labelers vote yes, no or abstain
on each: format, check (check digits, ranges, digit counts), gazetteer (top domains, issuer digits, key prefixes,
placeholder words), the words before the span (cues, and cues of something else), its neighbours, and its makeup. Only
the counts of each vote pattern leave Spark's aggregation: at most 3 ** 7 rows for each kind and feature value. EM for a
naive Bayes model with one reliability per labeler gives each pattern a probability; reliabilities start from a prior,
so that a kind whose candidates are all true isn't torn in two. The classifier is a logistic regression on the span's
own features, fitted to the counts of (features, vote pattern), which are a bounded number too.

Base spans always stay, whatever the classifier says. Defined results: a null or empty text has no spans; offsets
are code points, ends exclusive; repeated rows are judged alike, row by row; an empty table gives an empty result
(and no model); further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import checkpointed, map_batches

KINDS = ("email", "ip", "card", "phone", "secret")

# Base patterns, in forms that take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Patterns and gazetteers of further candidates (linear: what repeats is possessive or bounded).
SECRET = re.compile(r"""(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}["']?([^\s"',;]{4,}+)|(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])""", re.IGNORECASE)
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,63}+){0,8}")
# Digits first, then what may not stand before them: the search for a first digit is fast.
LOOSE_IP = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,5}+(?:\.[0-9]{1,6}+){3}(?![0-9.])")
LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_CARD = re.compile(r"[0-9](?<![0-9A-Za-z][0-9])(?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")
LOOSE_PHONE = re.compile(r"[0-9(](?<![0-9A-Za-z+.-][0-9(])(?:(?<=\()[0-9]{3}\) ?|(?<!\()[0-9]{2,3}[ .-])(?:[0-9]{3}[ .-][0-9]{4}|[0-9]{2}[ .-][0-9]{2})(?![0-9A-Za-z])")
DIGIT = re.compile("[0-9]")
SECRET_MARKS = ("passw", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
CUES = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("password", "passwd", "token", "secret", "key"),
}
FALSE_CUES = ("version", "v", "isbn", "issn", "order", "example", "section", "page", "release", "date", "on", "since", "syntax", "optional")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk")
PLACEHOLDERS = ("required", "string", "optional", "none", "null", "true", "false", "your", "changeme", "example", "xxx", "hidden", "text", "value", "here")
CONTEXT_CHARS = 40
LABELERS = ("format", "check", "gazetteer", "cue", "false_cue", "makeup", "alone")
#: Before any vote is counted, a labeler that speaks is taken to be right in 8 of 10 cases, and this many cases were seen.
PRIOR_RIGHT, PRIOR_CASES = 0.8, 20.0
MIN_PROBABILITY, EM_ROUNDS, FIT_ROUNDS = 0.5, 50, 500


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap: from each @ the local part reaches back, at most to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        # A run of local characters is walked once: the next @ starts after this one.
        done, at = max(done, at + 1), text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the looser patterns that overlap none of the spans before them."""
    found, taken = list(base), sorted((a, b) for _, a, b in base)
    more, low = [], text.lower()
    if any(x in low for x in SECRET_MARKS):
        more += [(4, m.start(g), m.end(g)) for m in SECRET.finditer(text) for g in (1, 2) if m[g]]
    loose = [(0, LOOSE_EMAIL)] * ("@" in text or "at]" in low or "at)" in low) + [(1, LONG_IP)] * (text.count(":") >= 7)
    if DIGIT.search(text):
        loose += [(1, LOOSE_IP), (2, LOOSE_CARD), (3, LOOSE_PHONE)]
    for kind, pattern in loose:
        more += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if more:
        starts = [a for a, _ in taken]
        for kind, a, b in sorted(more, key=lambda x: (x[0] != 4, *x[1:])):  # an assigned value is a secret, whatever it looks like
            at = bisect_right(starts, a)
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                found.append((kind, a, b))
                taken.insert(at, (a, b))
                starts.insert(at, a)
    return found


def check(kind: int, span: str) -> bool | None:
    """Whether what can be worked out of a span holds: domain, range, check digit, number of digits, letters with digits."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 0:
        return bool(re.search(r"(?:\.|[\[(](?:dot|DOT)[\])] ?)[A-Za-z]{2,}$", span))
    if kind == 1:
        return ":" in span or all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        return luhn(digits)
    if kind == 3:
        return len(digits) == 10 or span.startswith("+")
    kinds = (any(c.islower() for c in span), any(c.isupper() for c in span), bool(digits), any(not c.isalnum() for c in span))
    return len(span) >= 6 and ((kinds[2] and any(kinds[:2])) or sum(kinds) >= 3)


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> str:
    """One letter for each labeler: y, n or - (abstains). What any candidate of the kind would show is no vote."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT_CHARS) : start].lower(), text[end : end + 1]
    cues, low, digits = re.findall(r"[a-z]+", before), span.lower(), sum(c.isdigit() for c in span)
    vote = lambda yes, no=False: "y" if yes else "n" if no else "-"
    domain = re.split(r"[^a-z0-9]+", low)[-1]
    formats = (
        vote(is_base or re.search(r"[\[(]at", low)), vote(is_base or ":" in span, True), vote(False, not 15 <= digits <= 16),
        vote(is_base or span[0] in "+(", not re.fullmatch(r"[0-9]{3}.[0-9]{3}.[0-9]{4}", span)), vote(False, len(span) < 8),
    )
    gazetteers = (
        vote(domain in TOP_DOMAINS, not domain.isalpha() or domain in ("localhost", "host")), "-", vote(False, span[0] not in "3456"),
        vote(False, re.match(r"(?:19|20)[0-9][0-9][ .-]", span)), vote(span.startswith(KEY_PREFIXES), any(p in low for p in PLACEHOLDERS)),
    )
    makeup = ("-", "-", vote(False, len(set(span) - set(" -")) <= 4), "-", vote(digits and digits < len(span), span.isalpha()))
    return "".join((
        formats[kind], vote(check(kind, span), True), gazetteers[kind], vote(set(cues) & set(CUES[KINDS[kind]])),
        vote(False, set(cues[-3:]) & set(FALSE_CUES)), makeup[kind], vote(False, after and (after.isalnum() or after in "_-")),
    ))


def features(text: str, kind: int, start: int, end: int) -> str:
    """The span's own features, few and coarse: kind, length class, shares of digits and letters, what stands before it,
    case, whether its check holds, its first sign, and whether placeholder words are in it."""
    span = text[start:end]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    quarter = lambda x: min(3, 4 * x // max(1, len(span)))
    before = text[start - 1] if start else " "
    return f"{kind}{min(7, len(span).bit_length())}{quarter(digits)}{quarter(letters)}{'s' if before.isspace() else 'q' if before in chr(34) + chr(39) + '=:(' else 'o'}{int(span != span.lower())}{'ny'[bool(check(kind, span))]}{span[0] if span[0] in "+(3456" else "9" if span[0].isdigit() else "a"}{int(any(p in span.lower() for p in PLACEHOLDERS))}"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): base spans and further candidates, each as kind:start:end with votes and features."""

    def run(ids: list, texts: list) -> dict:
        out: dict = {"doc_id": ids, "base": [], "more": []}
        for text in texts:
            text = text or ""
            base = base_spans(text)
            known, found = set(base), candidates(text, base)
            rows = [{"kind": k, "start": a, "end": b, "votes": votes(text, k, a, b, (k, a, b) in known), "features": features(text, k, a, b)} for k, a, b in found]
            out["base"].append(rows[: len(base)])
            out["more"].append(rows[len(base) :])
        return out

    span = "array<struct<kind: int, start: int, end: int, votes: string, features: string>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {span}, more {span}")


def reliabilities(patterns: dict[str, float]) -> tuple[dict[str, float], np.ndarray]:
    """EM over vote patterns and their counts. Returns each pattern's probability and, by labeler, the chances of
    (y, n, -) given a true and given a false span. Votes start as a majority."""
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], float)
    shown = np.array([["yn-".index(c) for c in p] for p in names])
    score = (shown == 0).sum(axis=1) - (shown == 1).sum(axis=1)
    prob = 1 / (1 + np.exp(-score.astype(float)))
    # What each vote counts before any was seen: as often silent as here, else right in PRIOR_RIGHT of all cases.
    silent = ((shown == 2) * counts[:, None]).sum(axis=0) / counts.sum()
    speaks = PRIOR_CASES * (1 - silent)[:, None, None] * np.array([[PRIOR_RIGHT, 1 - PRIOR_RIGHT], [1 - PRIOR_RIGHT, PRIOR_RIGHT]])
    prior_votes = np.concatenate([speaks, np.broadcast_to(PRIOR_CASES * silent[:, None, None], (len(silent), 2, 1))], axis=2) + 0.01
    chances = np.zeros((shown.shape[1], 2, 3))
    for _ in range(EM_ROUNDS):
        for i in range(shown.shape[1]):
            for v in range(3):
                chances[i, 0, v] = prior_votes[i, 0, v] + (counts * prob)[shown[:, i] == v].sum()
                chances[i, 1, v] = prior_votes[i, 1, v] + (counts * (1 - prob))[shown[:, i] == v].sum()
        chances /= chances.sum(axis=2, keepdims=True)
        prior = np.clip((counts * prob).sum() / counts.sum(), 0.05, 0.95)
        odds = np.log(prior / (1 - prior)) + sum(np.log(chances[i, 0, shown[:, i]] / chances[i, 1, shown[:, i]]) for i in range(shown.shape[1]))
        prob = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(names, prob)), chances


def inputs(feature: str) -> list[str]:
    """Names of the classifier's active inputs: the kind, and each other feature within its kind."""
    return [feature[0], *(f"{feature[0]}{i}{c}" for i, c in enumerate(feature[1:]))]


def fit(pairs: dict[tuple[str, str], float], prob: dict[str, float]) -> dict[str, float]:
    """Logistic regression of the pattern's probability on the features, by gradient steps over the distinct pairs."""
    names = sorted({x for f, _ in pairs for x in inputs(f)})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(pairs), len(names) + 1))
    x[:, -1] = 1
    for row, (f, _) in enumerate(pairs):
        x[row, [at[n] for n in inputs(f)]] = 1
    target, weight = np.array([prob[v] for _, v in pairs]), np.array(list(pairs.values()), float)
    weight, w = np.sqrt(weight) / np.sqrt(weight).sum(), np.zeros(len(names) + 1)
    for _ in range(FIT_ROUNDS):
        w -= 2.0 * (x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target)) + 1e-4 * w)
    return dict(zip([*names, ""], w.tolist()))


def probability(model: dict[str, float], feature: str) -> float:
    return 1 / (1 + np.exp(-(model.get("", 0.0) + sum(model.get(x, 0.0) for x in inputs(feature)))))


def train(scanned: DataFrame) -> dict[str, float]:
    """Weights from the counts of all candidates; {} if there are none."""
    rows = scanned.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.features", "s.votes").count().collect()
    if not rows:
        return {}
    pairs = {(r.features, r.votes): float(r["count"]) for r in sorted(rows)}
    prob: dict[str, float] = {}
    for kind, group in groupby(sorted(pairs), key=lambda p: p[0][0]):
        totals: dict[str, float] = {}
        for f, v in group:
            totals[kind + v] = totals.get(kind + v, 0) + pairs[f, v]
        got, _ = reliabilities({v[1:]: n for v, n in totals.items()})
        prob |= {kind + v: p for v, p in got.items()}
    return fit({(f, f[0] + v): n for (f, v), n in pairs.items()}, prob)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans with the added ones, as arrays of (kind, start, end) in order."""
    scanned = checkpointed(scan(docs))
    model = train(scanned)

    def run(ids: list, bases: list, mores: list) -> dict:
        pick = lambda s: {"kind": s["kind"], "start": s["start"], "end": s["end"]}
        order = lambda s: (s["kind"], s["start"])
        added = [[s for s in more if probability(model, s["features"]) >= MIN_PROBABILITY] for more in mores]
        return {"doc_id": ids, "base": [sorted(map(pick, b), key=order) for b in bases], "spans": [sorted(map(pick, b + a), key=order) for b, a in zip(bases, added)]}

    span = "array<struct<kind: int, start: int, end: int>>"
    return map_batches(scanned, run, f"doc_id long, base {span}, spans {span}")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of the base spans and the list of all spans for each document."""
    found = find_personal_data(docs)
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    counts = [_count(i).alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
