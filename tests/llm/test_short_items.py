"""Recall of benchmark items by length, inside texts and at their ends."""

import random

import brute
import pytest

from glucoflow.llm import decontaminate

VOCABULARY = [f"w{k}" for k in range(300)]


def recall(length: int, where: str, edit: str) -> float:
    """Share of items found whose copy has all the edits that it may have."""
    rng = random.Random(f"{length} {where} {edit}")
    items = decontaminate.Items([(k, " ".join(rng.choices(VOCABULARY, k=length))) for k in range(100)])
    hits = 0
    for k, words in enumerate(items.words):
        w = [x.decode() for x in words]
        budget = items.budget[k]
        if edit == "first":
            w = ["other"] * budget + w[budget:]
        elif edit == "last":
            w = w[: len(w) - budget]
        else:
            for _ in range(budget):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 1)] = [rng.choice(VOCABULARY)] if kind < 2 else []
        before, after = ([] if where == side else rng.choices(VOCABULARY, k=20) for side in ("start", "end"))
        text = [*before, *w, *after]
        assert brute.edit_distance_within(words, [x.encode() for x in text]) <= budget
        hits += k in {m[0] for m in decontaminate.matches(items, [" ".join(text)])[0]}
    return hits / len(items.words)


@pytest.mark.parametrize("edit", ["first", "last", "any"])
@pytest.mark.parametrize("where", ["inside", "start", "end"])
@pytest.mark.parametrize("length", range(1, 20))
def test_short_items_are_all_found(length, where, edit):
    assert recall(length, where, edit) == 1


@pytest.mark.parametrize("where", ["inside", "start", "end"])
@pytest.mark.parametrize("length", [20, 25, 30, 40])
def test_longer_items(length, where):
    assert recall(length, where, "any") >= 0.95
