"""Learned boundaries on planted abbreviations."""

from __future__ import annotations

import random

from veracol.functions import text as t
from veracol.operators import boundaries


def planted(n: int):
    """Texts with abbreviations inside sentences, and how many sentences each has."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioubcdfglmnrst", k=rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        said = []
        for _ in range(rng.randrange(2, 6)):
            sentence = ["The" if rng.random() < 0.5 else rng.choice(words).title(), *rng.choices(words, k=rng.randrange(6, 12))]
            for _ in range(rng.randrange(3)):
                sentence.insert(rng.randrange(1, len(sentence)), rng.choice(["Dr.", "st.", "e.g.", "No."]))
            said.append(" ".join(sentence))
        rows.append((i, ". ".join(said) + ".", len(said)))
    return rows


def test_planted_abbreviations_end_no_sentence(spark):
    rows = planted(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.word for r in boundaries.abbreviations(boundaries.word_counts(docs)).collect()}
    assert {"dr", "st", "e.g", "no"} <= found and len(found) < 10
    got = {r.doc_id: r["count"] for r in boundaries.split(docs).groupBy("doc_id").count().collect()}
    plain = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "text").withColumn("n", t.sentence_list(docs["text"])).selectExpr("doc_id", "size(n) AS n").collect()}
    false_now = sum(abs(got[i] - n) for i, _, n in rows)
    false_before = sum(abs(plain[i] - n) for i, _, n in rows)
    assert false_now * 20 < false_before


def test_a_starter_ends_a_sentence_after_an_abbreviation(spark):
    docs = [(i, f"The w{i} x y came{i}. The v{i} z went{i}. So did st. u{i} and all st. b{i} there{i}.") for i in range(60)] + [(99, "He lives in st. The end of it. So st. u1 is here")]
    got = [r.sentence for r in boundaries.split(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 99").orderBy("sent_idx").collect()]
    assert got == ["He lives in st", "The end of it", "So st. u1 is here"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "no stop at all"), (5, ". . ."), (6, "1. 2. 3."), (7, "a. " * 20_000)], "doc_id long, text string")
    rows = {(r.doc_id, r.sent_idx) for r in boundaries.split(docs).collect()}
    assert (4, 0) in rows and not {1, 2, 3} & {d for d, _ in rows}
    assert boundaries.split(docs.limit(0)).collect() == []
