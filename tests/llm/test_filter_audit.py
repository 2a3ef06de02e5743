"""The filter interaction audit against loops over rows and orders."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veracol.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and least[text] < i else set()
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total, seen = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for step in range(5):
                now, earlier = order[step], set(order[:step])
                here = [d for d in mine if now in d[1] and not d[1] & earlier]
                kept = [d for d in mine if not d[1] & (earlier | {now})]
                redundant = [d for d in mine if now in d[1] and d[1] & earlier]
                total[now] += len(here)
                seen.append((order, step + 1, now, len(kept), len(here), len(redundant), sum(d[1] == {now} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)))
        out += [(part, order, step, *rest, total[now]) for order, step, now, *rest in seen]
    return sorted(out)


def some(n: int, seed: int = 3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words if rng.random() < 0.6 else words[:20], k=rng.choice([0, 5, 99, 100, 150])))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(["", "", " #", "\n|", " É"])
        rows.append((rng.randrange(n), text, rng.choice(["en", "en", "de", None, ""])))
    hot = " ".join(f"h{i}" for i in range(120))
    rows += [(10_000 + i, hot, rng.choice(["en", "fr"])) for i in range(n)]
    rows += rows[: n // 5]  # repeated rows
    rows += [(None, hot, "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (2, "", "en"), (3, "x" * 200_000, "en"), (7, "x" * 200_000, "de")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 37])
def test_query_against_loops(spark, parts):
    rows = some(150)
    rng = random.Random(1)
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1), (10_001, 1, 1), (10_001, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("part", "mask", "print", "n", "good", "edge_text")}).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        # Many small parts, so that groups lie across many boundaries.
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        masks = fa.masked(docs)
        assert masks.count() == len(rows)
        got = fa.audit(fa.counters(masks, spark.createDataFrame(labels, LABELS))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == brute(rows, labels)


def batch(rows):
    columns = zip(*rows, strict=True)
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "part", "text", "print", "mask"])


def test_texts_that_share_a_fingerprint_stay_apart():
    # doc_id, part, text, print, mask in the order of the sort; two texts share print 5, a run crosses batches.
    rows = [(1, "p", "a", 5, 0), (4, "p", "a", 5, 0), (2, "p", "b", 5, 0), (3, "p", "b", 5, 0), (9, "p", "c", 6, 0), (10, "p", "c", 6, 0), (None, "p", "d", 7, 0), (5, "p", "d", 7, 0), (6, "p", "d", 7, 0)]
    for cuts in ([len(rows)], [1, 2, 3, 5, 7, 8, len(rows)], range(1, len(rows) + 1)):
        cuts = [0, *cuts]
        out = [r for b in fa._compared(iter([batch(rows[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)])) for r in b.to_pylist()]
        assert {r["doc_id"]: r["mask"] for r in out} == {1: 0, 4: 16, 2: 0, 3: 16, 9: 0, 10: 16, None: 0, 5: 0, 6: 16}
        edges = {(r["doc_id"], r["edge_print"]) for r in out if r["edge_text"] is not None}
        assert edges == {(1, 5), (2, 5), (5, 7)}  # what another part may decide: unled rows of the first and last print
        assert len({r["edge_text"] for r in out} - {None}) == 3


def test_counters_of_parts_add_up(spark):
    docs, labels = spark.createDataFrame(some(40), SCHEMA), spark.createDataFrame([(1, 1, 0)], LABELS)
    counts = fa.counters(fa.masked(docs), labels)
    halves = counts.where("mask % 2 = 0").unionByName(counts.where("mask % 2 = 1")).unionByName(counts)
    summed = halves.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    twice = {tuple(r[:3]): r[3:] for r in fa.audit(summed).collect()}
    once = {tuple(r[:3]): r[3:] for r in fa.audit(counts).collect()}
    assert twice == {k: tuple(2 * x for x in v) for k, v in once.items()}


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert fa.audited(docs, labels).collect() == []
