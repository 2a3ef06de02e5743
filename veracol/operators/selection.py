"""Exact order statistics of a column of any size, by narrowing histograms.

Doubles are mapped to integers of the same order (their bits, the negative ones turned round). Four passes fix sixteen
bits each: a pass counts the values that share the bits found so far by their next sixteen, and the counts, at most
65,536 for each wanted rank, say where the rank lies. No buffer and nothing that reaches the driver grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracol.sources.stored import scratch, stored

#: Bits that a pass fixes, and the place of each pass's bits.
BITS, SHIFTS = 16, (48, 32, 16, 0)


def ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one, NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def unordered(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ np.int64(2**63 - 1), keys).view(np.float64)


def by_rank(df: DataFrame, column: str, wanted) -> tuple[int, list[float]]:
    """The count n of values that are not null, and the values at the ranks (from 0, ascending) that wanted(n) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ordered(batch.column(0).to_numpy(zero_copy_only=False)))], names=["key"])

    keys = stored(df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL").mapInArrow(run, "key long"), scratch(df.sparkSession, "selection"))
    n = keys.count()
    ranks = wanted(n) if n else []
    # Of each rank: the bits found so far, and its rank among the values that share them.
    found: dict[int, tuple[int | None, int]] = {r: (None, r) for r in ranks}
    for shift in SHIFTS:
        prefix, part = F.shiftright("key", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("long"), F.shiftright("key", shift)
        known = {p for p, _ in found.values()}
        rows = keys if None in known else keys.where(prefix.isin(sorted(known)))
        counts = sorted((r.prefix, r.part, r.n) for r in rows.groupBy(prefix.alias("prefix"), part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        for rank, (before, left) in found.items():
            for p, bits, count in counts:
                if before is None or p == before:
                    if left < count:
                        found[rank] = (bits, left)
                        break
                    left -= count
    return n, [float(unordered(np.array([found[r][0]]))[0]) for r in ranks]


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, between two values in proportion; None without values."""
    place = lambda n: share * (n - 1)
    n, values = by_rank(df, column, lambda n: [int(place(n)), min(int(place(n)) + 1, n - 1)])
    if not n:
        return None
    rest = place(n) - int(place(n))
    return values[0] if rest == 0 else (1 - rest) * values[0] + rest * values[1]
