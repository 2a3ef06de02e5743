"""The best title against all pairs."""

from __future__ import annotations

import random

import pytest

from veracol.functions import lexicons as lx
from veracol.operators import lookup


@pytest.mark.parametrize("least", [0.45, 0.9])
def test_against_all_pairs(spark, least):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    titles = [(i % 30, i // 30, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.choice([1, 3, 8, 20])))) for i in range(120)]
    titles += [(77, 0, ""), (78, 0, None), (79, 0, "of an")]
    requests = [(i, " ".join(rng.choices(words, k=rng.choice([0, 2, 10, 30])))) for i in range(60)] + [(90, None), (91, "unknown words"), (92, titles[5][2] + " and more")]
    told = lambda x: {w for w in (x or "").split() if len(w) >= 3 and w not in lx.TITLE_STOP_WORDS}
    want = set()
    for i, q in requests:
        fits = [(-len(told(q) & told(x)) / len(told(x)), a, b, x) for a, b, x in titles if told(x)]
        fits = sorted(f for f in fits if -f[0] >= least)
        if fits:
            want.add((i, *fits[0][1:], -fits[0][0]))
    got = lookup.best_titles(spark.createDataFrame(requests, "id long, q string"), spark.createDataFrame(titles, "a long, b long, title string"), "id", "q", ["a", "b"], "title", least)
    assert {tuple(r) for r in got.collect()} == want and want
