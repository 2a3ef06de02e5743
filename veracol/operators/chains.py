"""Longest chains of marked tokens along the heads of a parse, by pointer doubling.

A token's chain goes from it to its head as long as both are marked. In each round every token adds the chain of the
token that it points to and then points to where that one points, so that chains double: a chain of n tokens takes
about log2(n) rounds, for all sentences of a batch at once, without recursion. What still points somewhere after as many
rounds as the longest sentence allows is caught in a cycle.

Defined cases: heads out of range (a root's -1 too) and null heads end a chain; null marks are no marks; an empty or null
sentence has chain 0; a sentence whose marked tokens run into a cycle is cyclic and its chain null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest(heads: np.ndarray, marked: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sentences laid end to end: the longest chain of each, and whether it has a cycle of marked tokens.

    heads: each token's head by its place in its own sentence.
    """
    starts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.clip(heads, -1, total) + starts[own]
    inside = (heads >= 0) & (heads < sizes[own])
    to = np.where(inside & marked, at, -1)
    to[to >= 0] = np.where(marked[to[to >= 0]], to[to >= 0], -1)
    length = marked.astype(np.int64)
    for _ in range(int(sizes.max(initial=0)).bit_length()):
        go = np.flatnonzero(to >= 0)
        if not len(go):
            break
        next_ = to[go]
        length[go], to[go] = length[go] + length[next_], to[next_]
    best, cyclic = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    np.maximum.at(best, own, length)
    np.logical_or.at(cyclic, own, to >= 0)
    return best, cyclic


def with_chains(rows: DataFrame, parse: Callable[[Column], tuple[Column, Column]], text: str = "sentence") -> DataFrame:
    """Adds chain and cyclic. parse: the text's column to its heads (array of places from 0) and marks (array of boolean);
    a model's parse comes as columns of its own, which such a function names."""
    heads, marks = parse(F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_heads")
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
            at = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            marked = pc.fill_null(batch.column("_marks").flatten(), False).to_numpy(zero_copy_only=False).astype(bool)
            best, cyclic = longest(at, marked, sizes)
            kept = [batch.column(f) for f in batch.schema.names if f not in ("_heads", "_marks")]
            names = [f for f in batch.schema.names if f not in ("_heads", "_marks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.int64(), mask=cyclic), pa.array(cyclic)], names=[*names, "chain", "cyclic"])

    ready = rows.select("*", heads.cast("array<int>").alias("_heads"), marks.cast("array<boolean>").alias("_marks"))
    # Both arrays tell of the same tokens.
    size = F.least(F.size("_heads"), F.size("_marks"))
    ready = ready.withColumns({c: F.when(size > 0, F.slice(c, F.lit(1), F.greatest(size, F.lit(1)))) for c in ("_heads", "_marks")})
    return ready.mapInArrow(run, f"{schema}, chain long, cyclic boolean")
