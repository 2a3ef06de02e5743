"""The impact index against scoring of all postings."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from veracol.operators import impact_index, retrieval


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    for step in (1, 200, 60_000, 2**31, 2**40):
        numbers = np.cumsum(rng.integers(1, step + 1, size=77))
        assert (impact_index.unpacked(int(numbers[0]), impact_index.packed(numbers)) == numbers).all()
    assert impact_index.unpacked(5, impact_index.packed(np.array([5]))).tolist() == [5]


def test_blocks_do_not_depend_on_batches():
    rng = random.Random(2)
    rows = sorted({(rng.choice("abc"), rng.randrange(10**6)) for _ in range(900)})
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[1] / 10**6 for r in part], pa.float64())], names=["term", "number", "sat"])
    got = []
    for size in (900, 7, 128, 129):
        out = [r for b in impact_index._blocks(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert all(r["n"] <= impact_index.BLOCK for r in out)
        back = [(r["term"], int(n)) for r in out for n in impact_index.unpacked(r["first"], r["gaps"])]
        assert back == rows
        assert all(r["top"] == max(np.frombuffer(r["sats"], np.float32)) for r in out)
        got.append(out)
    assert got[0] == got[1] == got[2] == got[3]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_against_all_postings(spark, k, monkeypatch):
    monkeypatch.setattr(impact_index, "BLOCK", 4)
    monkeypatch.setattr(impact_index, "PROMISING", 3)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(d, i, text(rng.choice([0, 1, 5, 30]))) for d in range(60) for i in range(rng.randrange(4))]
    rows += [(100 + d, 0, "w1 w2 w3") for d in range(8)] + [(200, 0, "only here")]  # ties
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk string")
    asked = [(i, text(rng.choice([1, 3, 40]))) for i in range(25)] + [(90, "w1 w2 w3"), (91, "unknown words"), (92, ""), (93, None), (94, "w0"), (95, "here w0 w0 W1")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    found = impact_index.search(queries, impact_index.built(chunks, "doc_id"), k)
    want = retrieval.top_k(queries, retrieval.postings(chunks, [], "doc_id"), [], "doc_id", k)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found.best) == key(want) != []
    read = impact_index.read(found).collect()
    assert all(0 <= r.second_pass <= r.all_postings and r.first_pass <= r.all_postings for r in read)
    if k == 1:
        assert sum(r.second_pass for r in read) < sum(r.all_postings for r in read)


def test_empty_corpus(spark):
    chunks = spark.createDataFrame([], "doc_id string, chunk_index int, chunk string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert impact_index.search(queries, impact_index.built(chunks, "doc_id")).best.collect() == []
