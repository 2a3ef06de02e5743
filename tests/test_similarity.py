"""Shared grams counted by matrix and by rows, against sets."""

from __future__ import annotations

import random
import tracemalloc

import pytest

from veracol.operators import similarity


def grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def found(index, texts, threshold):
    return {(int(a), int(b)): float(r) for part in index.similar(texts, threshold) for a, b, r in zip(*part, strict=True)}


@pytest.mark.parametrize(("entries", "counters", "one_in"), [(1 << 21, 1 << 22, 16), (50, 1 << 22, 16), (1 << 21, 90, 3), (1 << 21, 1 << 22, 10**9), (1 << 21, 1 << 22, 0)])
def test_similar_against_sets(monkeypatch, entries, counters, one_in):
    monkeypatch.setattr(similarity, "ENTRIES", entries)
    monkeypatch.setattr(similarity, "COUNTERS", counters)
    monkeypatch.setattr(similarity, "ONE_IN", one_in)
    rng = random.Random(entries + counters)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 9, 60])))
    library = [text("abc") for _ in range(40)] + ["ж𝒜б" * 4, "", "xyz"]
    texts = [text(rng.choice(["abc", "ab", "abcжб𝒜", "qrs"])) for _ in range(150)] + ["", *library]
    for threshold in (0.0, 0.2, 0.45, 0.9):
        ratio = {(i, j): len(grams(x) & grams(y)) / max(1, len(grams(x) | grams(y))) for i, x in enumerate(texts) for j, y in enumerate(library)}
        assert found(similarity._Index(library), texts, threshold) == {k: r for k, r in ratio.items() if r > threshold}
    assert found(similarity._Index(["", "a"]), texts, 0.1) == {}


def test_every_character_there_is():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert found(similarity._Index(["abcd", every[-50:]]), [every, "abc", *["zzz"] * 8, every[-40:]], 0.4) == {(1, 0): 0.5, (10, 1): 38 / 48}


def test_frequent_grams_need_little_memory():
    """A pair for each gram of a text and each library row that has it would take hundreds of MB."""
    rng = random.Random(7)
    library = ["".join(rng.choice("abcdefghij") for _ in range(400)) for _ in range(200)]
    texts = ["".join(rng.choice("abcdefghij") for _ in range(400)) for _ in range(800)]
    index = similarity._Index(library)
    tracemalloc.start()
    got = list(index.similar(texts, 0.99))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x[0]) for x in got) == 0 and most < 100 << 20
