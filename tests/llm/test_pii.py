"""The skip-chain field: messages against enumeration, learned weights, checks, hostile texts, the whole query."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest

from veracol.llm import pii_crf
from veracol.llm.pii_crf import KINDS, LABELS, Document, Field

TRAIN = ["call +1(456)5552186 now, 12 times", "plain 12 words, 2 of 3", "mail a.b@c.de or 10.0.0.1", "pay 4111 1111 1111 1111 by 3 pm", "number 123456789012345 is none, 98765432101 is none"] * 20


@pytest.fixture(scope="module")
def field():
    return pii_crf.fit_texts(TRAIN)


def enumerated(doc: Document, field: Field) -> np.ndarray:
    """Marginals by summing over every labelling of units and hubs."""
    k, n = len(LABELS), len(doc.label)
    hubs = sorted(set(doc.twin[doc.twin >= 0].tolist()))
    out = np.zeros((n, k))
    score = doc.features @ field.token
    for labels in product(range(k), repeat=n + len(hubs)):
        own, hub = labels[:n], dict(zip(hubs, labels[n:], strict=True))
        if any(own[i] != doc.label[i] for i in range(n) if doc.base[i]):
            continue
        s = 0.0
        for i in range(n):
            s += score[i, own[i]] + (field.skip if doc.twin[i] >= 0 and hub[doc.twin[i]] == own[i] else 0)
            s += field.chain[own[i - 1] if doc.follows[i] else 0, own[i]]
            if i + 1 == n or not doc.follows[i + 1]:
                s += field.chain[own[i], 0]
        for i in range(n):
            out[i, own[i]] += np.exp(s)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_are_exact_without_loops():
    rnd = np.random.default_rng(3)
    k = len(LABELS)
    for follows, twin in (([0, 1, 1], [-1, -1, -1]), ([0, 0, 0], [0, 0, 0]), ([0, 1, 0, 0], [-1, 0, 0, -1]), ([0, 1, 0], [0, -1, 0])):
        n = len(twin)
        for observed in (False, True):
            base = np.zeros(n, bool)
            base[-1] = observed
            doc = Document([(i, i + 1) for i in range(n)], rnd.normal(size=(n, 2)), np.full(n, 2), base, np.array(follows, bool), np.array(twin))
            field = Field(rnd.normal(size=(2, k)), rnd.normal(size=(k, k)) / 2, 1.3)
            assert np.allclose(pii_crf.marginals(doc, field), enumerated(doc, field), atol=2e-3)


def test_loops_stay_near_the_exact_marginals():
    rnd = np.random.default_rng(4)
    doc = Document([(i, i + 1) for i in range(4)], rnd.normal(size=(4, 2)), np.zeros(4, int), np.zeros(4, bool), np.array([0, 1, 1, 1], bool), np.array([0, 1, 0, 1]))
    field = Field(rnd.normal(size=(2, 5)), rnd.normal(size=(5, 5)) / 4, 0.8)
    assert np.allclose(pii_crf.marginals(doc, field), enumerated(doc, field), atol=0.05)


def test_learned_skip_weight_decides(field):
    assert field.skip > 0.5
    text = "call +44 20 7946 0958 today and again 44/207/9460958 later, not 55/318/1122334"
    base = pii_crf.base_spans(text)
    assert pii_crf.added_spans(text, base, field) == [("phone", text.index("44/"), text.index(" later"))]
    assert pii_crf.added_spans(text, base, dataclasses.replace(field, skip=0.0)) == []


def test_added_spans_pass_their_check(field):
    sure = Field(np.where(np.arange(5) == 3, 5.0, 0.0) * np.ones((pii_crf.N_FEATURES, 1)), np.zeros((5, 5)), 0.0)
    assert pii_crf.added_spans("x 4111.1111.1111.1111 y", [], sure) == [("card", 2, 21)]
    assert pii_crf.added_spans("x 4111.1111.1111.1112 y 12", [], sure) == []
    assert pii_crf.passes("ip", "10-0-0-1") and not pii_crf.passes("ip", "10-0-0-256") and not pii_crf.passes("email", "a@b")


def plain(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_of_dotted_numbers():
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(rnd.choice(["1", "25", "256", "0", ".", ".", "..", " ", "x", "00012", "+", "@a.b", "-", "4111111111111111"]) for _ in range(rnd.randint(0, 20)))
        assert pii_crf.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["1.1.1." + "0" * 5000, "9" * 1_000_000, "+" + "1" * 1_000_000, "a" * 1_000_000 + "@", "@a" * 200_000, "1-" * 300_000, "1." * 100_000, "a@" + "b" * 1_000_000])
def test_hostile_texts(field, text):
    began = time.perf_counter()
    base = pii_crf.base_spans(text)
    pii_crf.added_spans(text, base, field)
    assert time.perf_counter() - began < 10
    assert text[:6] != "1.1.1." or [k for k, *_ in base] == ["ip"] or len(text) > 6000


def test_whole_query_against_the_patterns(spark):
    rnd = random.Random(7)
    bits = ["word", "a@b.cd", "10.0.0.1", "4111 1111 1111 1111", "+49 (30) 123456", "12", ",", "x@y", "300.1.1.1", "é", "\n"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "w " * 200_000 + "a@b.cd"), (5, rows[5][1]), (None, "10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii_crf.counted(docs).collect()}
    want = set()
    for i, text in rows:
        spans = sorted(plain(text or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.add((i, *[sum(k == x for k, *_ in spans) for x in KINDS], hashlib.sha256(said.encode()).hexdigest()))
    assert got == want
