"""Exact selection against sorting."""

from __future__ import annotations

import math

import numpy as np
import pytest

from veracol.operators import selection


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_keys_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.0, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    keys = selection.ordered(values)
    assert (np.diff(keys) >= 0).all() and keys[5] == keys[6] and len(set(keys.tolist())) == len(values) - 1
    back = selection.unordered(keys)
    assert ((back == values) | np.isnan(values)).all() and math.isnan(back[-1])


@pytest.mark.parametrize("n", [1, 2, 7, 400, 401])
def test_ranks_and_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, size=n), np.repeat(3.25, n // 2), [-0.0]])[:n]
    df = frame(spark, [*values.tolist(), None, None]).repartition(3)
    assert selection.by_rank(df, "x", lambda n: list(range(0, n, max(1, n // 5)))) == (n, sorted(values.tolist())[:: max(1, n // 5)])
    for share in (0.0, 0.5, 0.9, 1.0):
        # 0.5 of an even count lies between two values.
        want = np.quantile(values, share) if n > 2 else None
        got = selection.quantile(df, "x", share)
        assert want is None or math.isclose(got, want, rel_tol=1e-12, abs_tol=0) or got == want
    assert selection.quantile(df, "x", 0.5) == df.selectExpr("percentile(x, 0.5)").first()[0]


def test_ties_and_nothing(spark):
    assert selection.quantile(frame(spark, [2.5] * 9 + [7] * 4), "x", 0.5) == 2.5
    assert selection.quantile(frame(spark, [None]), "x", 0.5) is None
    assert selection.by_rank(frame(spark, []), "x", lambda n: [0]) == (0, [])
