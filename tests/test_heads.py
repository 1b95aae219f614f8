"""The beginning of a bundle's text, whatever stands where it is cut, and the prompts and requests that carry it."""

import json

from palisade.operators import bundles, model_layer
from palisade.operators.detect import FINDING
from palisade.plans import intake

FINDINGS = "bundle_id string, path string, line int, severity string, category string, description string, remediation string, engine string, confidence double, layer_ord int, n long"


def test_heads_are_whole_at_every_limit(spark):
    texts = [("a.md", "one"), ("b.md", ""), ("c.md", "drei ä"), ("d.md", "four")]
    whole = "\n\n".join(f"=== {p} ===\n{t}" for p, t in texts).encode()
    files = spark.createDataFrame([("b", p, t) for p, t in texts], "bundle_id string, path string, text string")
    for n in range(1, len(whole) + 3):
        body = bundles.bundle_heads(files, n).first().body.encode()
        assert len(body) >= min(n, len(whole)) and whole.startswith(body), n


def asked(spark):
    """The prompts of bundles whose first file ends around the limit, with what their bodies must be."""
    limit, start = model_layer.PROMPT_BYTES, len("=== a.md ===\n")
    rows = [(str(n), p, t) for n in range(limit - 4, limit + 3) for p, t in (("a.md", "x" * (n - start)), ("b.md", "second"))]
    files = spark.createDataFrame(rows, "bundle_id string, path string, text string")
    want = {str(n): ("=== a.md ===\n" + "x" * (n - start) + "\n\n=== b.md ===\nsecond")[:limit] for n in range(limit - 4, limit + 3)}
    return model_layer.prompts(bundles.bundle_heads(files, limit), spark.createDataFrame([], FINDINGS).select(*FINDING)), want


def test_prompts_hold_the_whole_beginning(spark):
    prompts, want = asked(spark)
    assert {r.bundle_id: r.prompt.partition(model_layer.BUNDLE_HEAD)[2] for r in prompts.collect()} == want


def test_requests_carry_the_whole_beginning(spark):
    prompts, want = asked(spark)
    got = {r.bundle_id: json.loads(r.request)["messages"][1]["content"] for r in model_layer.requests(prompts, "m").collect()}
    assert {b: p.partition(model_layer.BUNDLE_HEAD)[2] for b, p in got.items()} == want


def test_the_model_is_asked_with_the_whole_beginning(spark):
    prompts, want = asked(spark)
    call = intake.planned_model()

    def answer(body: str) -> str | None:
        try:
            return call(model_layer.FINDINGS_HEAD + "None" + model_layer.BUNDLE_HEAD + body)
        except TimeoutError:
            return None

    assert {r.bundle_id: r.response for r in model_layer.ask(prompts, call).collect()} == {b: answer(body) for b, body in want.items()}
