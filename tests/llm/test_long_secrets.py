"""Secrets of any length get a span to their end."""

import time

from palisade.llm import pii


def test_a_long_secret_is_one_whole_span():
    for size in (6, 256, 257, 600, 100_000):
        value = ("aB3" * size)[:size]
        text = f"token: {value}, then more"
        assert pii.candidates(text, pii.base_spans(text)) == [(4, 7, 7 + size)]
    start = time.process_time()
    pii.candidates(hostile := "token=" * 100_000, pii.base_spans(hostile))
    assert time.process_time() - start < 5
