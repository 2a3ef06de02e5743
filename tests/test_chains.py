"""Chains by pointer doubling against walking."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from veracol.operators import chains


def walked(heads, marked):
    best, cyclic = 0, False
    for i in range(len(heads)):
        n, at, seen = 0, i, set()
        while at is not None and 0 <= at < len(heads) and marked[at] and at not in seen:
            seen.add(at)
            n, at = n + 1, heads[at]
        cyclic |= at is not None and at in seen
        best = max(best, n)
    return (None if cyclic else best), cyclic


def test_against_walking(spark):
    rng = random.Random(9)
    rows = [(0, None, None), (1, [], []), (2, [-1], [True]), (3, [1, 0], [True, True]), (4, [1, 0], [True, False]), (5, [0], [True]), (6, [None, 0, 1], [True, True, None]), (7, [5, 0], [True, True])]
    for i in range(8, 200):
        n = rng.randrange(1, 40)
        heads = [rng.randrange(-1, j) if rng.random() < 0.98 else rng.randrange(n) for j in range(n)]
        rows.append((i, heads, [rng.random() < 0.8 for _ in range(n)]))
    df = spark.createDataFrame(rows, "id long, heads array<int>, marks array<boolean>").withColumn("sentence", F.lit("own"))
    got = {r.id: (r.chain, r.cyclic) for r in chains.with_chains(df, lambda _: (F.col("heads"), F.col("marks"))).collect()}
    assert got == {i: walked(h or [], [bool(m) for m in m_ or []]) for i, h, m_ in rows}
    assert any(c for _, c in got.values()) and sum(1 for x, _ in got.values() if x and x > 3) > 20


def test_a_chain_of_many_tokens():
    n = 100_000
    best, cyclic = chains.longest(np.arange(-1, n - 1), np.ones(n, bool), np.array([n]))
    assert best.tolist() == [n] and not cyclic.any()
    best, cyclic = chains.longest(np.r_[n - 1, np.arange(n - 1)], np.ones(n, bool), np.array([n]))
    assert cyclic.tolist() == [True]
