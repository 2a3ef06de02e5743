"""Scanning all chunks for carried queries, against scoring of all postings."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.operators import impact_index, retrieval, scan
from veracol.plans import catalog


def test_windows_are_the_chunks(spark):
    rng = random.Random(1)
    texts = ["", " ", "a", "x" * 500, "x" * 501, "x" * 800, " " + "y" * 900 + " ", "\x1c a\x85 b\x1f" * 200, "  a　 b᠎​" * 150, "𝒜б " * 700]
    texts += ["".join(rng.choice("ab İßK\n\t\x0b\x1d\x85 𝒜.") for _ in range(rng.randrange(2000))) for _ in range(60)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.chunks("x").alias("want"))
    assert all(scan.windows(r.x) == r.want for r in rows.collect())


def test_parts_are_rounded_as_decimals_are(spark):
    rng = np.random.default_rng(2)
    parts = np.r_[rng.random(5000) * 40, (rng.integers(0, 10**10, 5000) * 10 + 5) / 1e10, 0.0]
    want = spark.createDataFrame([(float(x),) for x in parts], "x double").select(F.col("x").cast(retrieval.CONTRIBUTION).alias("d")).collect()
    assert scan._billionths(parts).tolist() == [int(r.d * Decimal(10**9)) for r in want]


def corpus(spark, seed):
    rng = random.Random(seed)
    words, weights = [f"w{i}" for i in range(60)] + ["Слово", "ÉTÉ"], [1 / (i + 1) for i in range(62)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(d, text(rng.choice([0, 1, 30, 500]))) for d in range(60)] + [(100 + d, "w1 w2 w3") for d in range(40)] + [(200, "only here"), (201, None), (None, "only here")]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = [(i, text(rng.choice([1, 3, 40]))) for i in range(25)] + [(90, "w1 w2 w3"), (91, "unknown words"), (92, ""), (93, None), (94, "w0"), (95, "here w0 w0 W1"), (96, "слово t"), (97, "only here")]
    return docs, spark.createDataFrame(asked, "query_id int, query string")


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_against_all_postings(spark, k, monkeypatch):
    monkeypatch.setattr(scan, "CHUNKS", 7)
    docs, queries = corpus(spark, k)
    key = lambda df: sorted(map(tuple, df.collect()))
    named = docs.where("doc_id IS NOT NULL")
    want = key(retrieval.top_k(queries, retrieval.postings(retrieval.chunked(named, "doc_id", "text"), [], "doc_id"), [], "doc_id", k))
    for counters in (1 << 19, 100):
        monkeypatch.setattr(scan, "COUNTERS", counters)
        assert key(scan.search(queries, named, "doc_id", "text", k)) == want != []
    strings = scan.search(queries, named.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text", k)
    assert sorted(r.score for r in strings.collect()) == sorted(w[4] for w in want)
    # Null keys come first among ties.
    assert key(scan.search(queries.where("query_id = 97"), docs, "doc_id", "text", 1))[0][:3] == (97, 1, None)


def test_more_queries_than_tasks_carry(spark, monkeypatch):
    docs, queries = corpus(spark, 5)
    named = docs.where("doc_id IS NOT NULL")
    want = sorted(map(tuple, scan.search(queries, named, "doc_id", "text").collect()))
    monkeypatch.setattr(scan, "CARRIED", 10)
    assert sorted(map(tuple, scan.search(queries, named, "doc_id", "text").collect())) == want


def test_nothing_to_find(spark):
    docs, queries = corpus(spark, 6)
    assert scan.search(queries, docs.limit(0), "doc_id", "text").collect() == []
    assert scan.search(queries.where("query_id IN (91, 92, 93)"), docs, "doc_id", "text").collect() == []


@pytest.mark.parametrize("name", ["bm25_topk", "best_hit"])
def test_queries_move_no_postings(spark, name, monkeypatch):
    """Only the best chunks of each task are moved; an index would move all postings."""
    monkeypatch.setattr(impact_index, "built", None)
    found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
