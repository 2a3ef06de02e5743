"""The line field against enumeration of labellings, slopes by differences, and held-out labels."""

from __future__ import annotations

import itertools
import math
import random
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracol.llm import line_quality as lq

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int"


def potential(u, chain, y):
    return sum(u[i] for i, v in enumerate(y) if v) + sum(chain[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_marginals_by_enumeration(n):
    rng = np.random.default_rng(n)
    field = lq.Field(rng.normal(size=lq.WIDTH), rng.normal(size=(2, 2)), 0.0, 1.0)
    x = rng.random((n, lq.WIDTH)).astype(np.float32)
    u, chain = x @ field.weights, field.chain
    every = list(itertools.product((0, 1), repeat=n))
    p = np.array([math.exp(potential(u, chain, y)) for y in every])
    want = np.array([sum(q for q, y in zip(p, every) if y[i]) for i in range(n)]) / p.sum()
    assert np.allclose(field.bad(x), want)
    # The same in padded chains, beside a longer one.
    odds = np.ones((2, 9))
    odds[0, :n], odds[1] = np.exp(u), np.exp(rng.normal(size=9))
    inside = np.arange(9)[None] < np.array([[n], [9]])
    bad, pairs = lq._chains(odds, inside, chain)
    assert np.allclose(bad[0, :n], want) and not bad[0, n:].any()
    for a, b in itertools.product((0, 1), repeat=2):
        assert np.isclose(pairs[0, a, b], sum(q * sum(y[i : i + 2] == (a, b) for i in range(n - 1)) for q, y in zip(p, every)) / p.sum())


def test_lines_of_a_mixed_document_are_told_apart():
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(30))
    junk = lambda: " ".join(w + "&&&" for w in prose().split())
    good = ["\n".join(prose() for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    bad = ["\n".join([prose()] * rng.randrange(2) + [junk() for _ in range(rng.randrange(1, 4))] + [prose()] * rng.randrange(2)) for _ in range(90)]
    field = lq.fit_texts(good, bad, 120 / 210)
    lines = [prose(), prose(), junk(), junk(), prose(), prose()]
    chance = field.bad(lq.unit_features(lines))
    assert (chance[[2, 3]] > 0.9).all() and (chance[[0, 1, 4, 5]] < 0.3).all()
    share, n, n_bad = field.share("\n".join(["", *lines, "  "]))
    size = np.array([len(x) for x in lines])
    assert n == 6 and n_bad == 2 and np.isclose(share, chance @ size / size.sum())
    assert field.score(0.0) > 0.9 > 0.3 > field.score(0.9)


def test_features_see_whole_lines():
    text = "a b c " * 50_000 + "\nAAA!!! |||"
    x = lq.unit_features(lq.lines_of(text))
    assert x.shape == (2, lq.WIDTH)
    assert x[0, 2 * len(lq._CLASSES) + 2] > 0.99  # pairs of words repeat
    assert x[1, 0] == pytest.approx(3 / 10) and x[1, 10] == pytest.approx(3 / 10)
    assert (x[1, lq.OWN : 2 * lq.OWN] == x[0, : lq.OWN]).all() and (x[0, 2 * lq.OWN : 3 * lq.OWN] == x[1, : lq.OWN]).all()


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
def test_query_against_one_machine_and_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in lq.held_out_scores(docs, labels).collect()}
    out = lambda i: crc32(str(i).encode()) % 5 == 0
    label = {r.doc_id: r.quality for r in labels.collect()}
    ids = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(14))).collect()]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    seen = [i for i in ids if i in label and not out(i) and len(text[i]) <= lq.TRAIN_CHARS and text[i].count("\n") < lq.TRAIN_LINES]
    known = [q for i, q in label.items() if not out(i)]
    field = lq.fit_texts([text[i] for i in seen if label[i] == 1], [text[i] for i in seen if label[i] == 0], sum(known) / len(known))
    for i, t in text.items():
        assert got[i].score == pytest.approx(field.score(field.share(t)[0])) and got[i].held_out == out(i)
        assert got[i].predicted == (got[i].score >= 0.3)
    held = [i for i in label if out(i)]
    assert sum(got[i].predicted == label[i] for i in held) >= 0.95 * len(held)


def test_edges(spark):
    rows = [(i, t, "en") for i, t in enumerate([None, "", " \n\t\n", "x", "word " * 40_000, "a\n" * 5_000, "same", "same", "\x85  ퟿"])] + [(None, "no id", "en"), (3, "x", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("score", "quality", "_id", "_good", "bad_share", "predicted")})
    labels = spark.createDataFrame([(i, q) for i, q in enumerate([1, 0, 0, 1, 0, 1, 1, 1, 7, None])] + [(None, 0), (3, 1)], LABELS).withColumn("text", F.lit("own"))
    got = lq.held_out_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1 and len({r.score for r in got if r.doc_id in (6, 7)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in lq.held_out_scores(docs, none).collect()} == {1}
    assert lq.held_out_scores(spark.createDataFrame([], SCHEMA), none).collect() == []
