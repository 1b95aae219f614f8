"""Leaks with one word changed, at every place, and the alignment against dynamic programming."""

import random

from palisade.llm import decontaminate

QUESTION = "Which of the seven rivers that cross the northern plain floods its banks every spring and carries red clay down to the harbour?"
ANSWER = "The Orlen does so each year."


def slow_edits(part, passage):
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(part, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(passage, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_alignment():
    rng = random.Random(5)
    for _ in range(400):
        part, passage = ([b"%d" % rng.randint(0, 5) for _ in range(rng.randint(1, n))] for n in (90, 150))
        assert decontaminate.edits_to_piece(part, passage) == slow_edits(part, passage)


def test_one_word_edits_at_every_place():
    index = decontaminate.Index([(1, f"{QUESTION} {ANSWER}"), (2, "What do bakers add to the dough before dawn? Salt and rye meal go in."), (3, "How long is the old canal? It is nine miles long.")])
    words = f"{QUESTION} {ANSWER}".split()
    around = "some words of a page stand here before it"
    for k in range(len(words)):
        for changed in ([*words[:k], "otherwise", *words[k + 1 :]], [*words[:k], "otherwise", *words[k:]], [*words[:k], *words[k + 1 :]]):
            found = index.matches(f"{around} {' '.join(changed)} {around}")
            assert [m[0] for m in found] == [1], changed
    assert index.matches(f"{around} {QUESTION} {around}") == []
