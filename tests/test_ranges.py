"""Cases of the core engine that were once cut short."""

from __future__ import annotations

from veracol.operators import citations
from veracol.plans.rule_queries import SENTENCES


def test_long_ranges_are_expanded(spark):
    row = SENTENCES.df(spark).where("id = 6")
    got = citations.cited_numbers(row.selectExpr("id AS doc_id", "sentence AS text"))
    assert got.count() == 999_999
    listed = "".join(f"\n{i}. Entry" for i in range(1, 1501) if i != 700)
    docs = spark.createDataFrame([(1, f"Cites [1-1500].\nReferences{listed}\n1600. Entry"), (2, "Cites [1-999999999999], no list.")], "doc_id long, text string")
    rows = {(r.doc_id, r.number, r.issue_type) for r in citations.integrity(docs).collect()}
    assert rows == {(1, 700, "citation_missing_bibliography"), (1, 1600, "citation_unused_bibliography")}


def test_ranges_of_any_length_stay_intervals(spark):
    far = 10**21 - 1
    docs = spark.createDataFrame([
        (1, f"[1-3000000000] [5-{far}] [9-2] [{'9' * 40}]\nReferences\n7. A\n[{far}] B\n{far * 10}. C"),
        (2, "[3], [4-6], [8 ;\n9]"), (3, "[2-4] [3-9] [11]\nReferences\n3. A\n4. B\n12. C"), (4, None), (5, "References\n1. A"),
    ], "doc_id long, text string")
    ranges = {(r.doc_id, int(r.low), int(r.high)) for r in citations.cited_ranges(docs).collect()}
    assert ranges == {(1, 1, far), (2, 3, 6), (2, 8, 9), (3, 2, 9), (3, 11, 11)}
    rows = sorted((r.doc_id, int(r.low), int(r.high), r.issue_type[9:], int(r["index"])) for r in citations.integrity_ranges(docs).collect())
    assert rows == [
        (1, 1, 6, "missing_bibliography", -1), (1, 8, far - 1, "missing_bibliography", -7), (1, far * 10, far * 10, "unused_bibliography", -(far - 2) - 1),
        (3, 2, 2, "missing_bibliography", -1), (3, 5, 9, "missing_bibliography", -2), (3, 11, 11, "missing_bibliography", -7), (3, 12, 12, "unused_bibliography", -8), (5, 1, 1, "unused_bibliography", -1),
    ]


def test_intervals_against_sets(spark, monkeypatch):
    import random

    monkeypatch.setattr(citations, "SLICE", 3)
    rng = random.Random(5)
    texts = []
    for i in range(60):
        cites = [(a := rng.randrange(1, 60), a + rng.choice([-3, 0, 0, 1, 2, 30])) for _ in range(rng.randrange(6))]
        listed = rng.sample(range(1, 70), rng.randrange(12))
        texts.append((i, cites, listed, " ".join(f"[{a}-{b}]" if b != a else f"[{a}]" for a, b in cites) + "\nReferences" + "".join(f"\n{n}. E" for n in listed)))
    docs = spark.createDataFrame([(i, t) for i, _, _, t in texts], "doc_id long, text string")
    numbers = {(r.doc_id, int(r.number)) for r in citations.cited_numbers(docs).collect()}
    got = {(r.doc_id, int(r.number), r.issue_type, int(r["index"])) for r in citations.integrity(docs).collect()}
    want = set()
    for i, cites, listed, _ in texts:
        cited = {n for a, b in cites for n in range(a, b + 1)}
        assert {n for d, n in numbers if d == i} == cited
        warned = [("citation_missing_bibliography", n) for n in sorted(cited - set(listed))] + [("citation_unused_bibliography", n) for n in sorted(set(listed) - cited)]
        want |= {(i, n, kind, -k - 1) for k, (kind, n) in enumerate(warned)} if listed else set()
    assert got == want


def test_key_ranges_keep_what_keys_shorten(spark):
    row = spark.createDataFrame([("[Smith 2020; b21], [7-5], [1-3000000000; 4]",)], "s string").select(citations.key_ranges("s").alias("k"), citations.keys("s").alias("n")).first()
    assert [(x.key, x.low, x.high) for x in row.k] == [("smith2020", None, None), ("b21", None, None), (None, 1, 3_000_000_000), (None, 4, 4)]
    assert row.n == ["smith2020", "b21", "1", "3000000000", "4"]


def test_integrity_reads_each_text_once_and_sorts_once(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "concat('Cites [', id, '].\\nReferences\\n1. A') AS text")
    plan = citations.integrity_ranges(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(citations.BRACKET) == plan.count(citations.LISTED) == plan.count("lower(") == 1
    assert plan.count("Sort [") == 1 and plan.count("Exchange") <= 1


def test_odd_parts_and_lists(spark):
    nines = "9" * 38
    docs = spark.createDataFrame([
        (1, "[1 2, 3 – 5; 7--9, 1-2-3,, 007 , 12-] [9-8] [4\t—\n6]\nReferences\n5. A\n05. B\n[5] C\n20. D\n020. E"),
        (2, f"[{nines}] [3]\nReferences\n[{nines}] A"), (3, f"[1]\nReferences\n{'8' * 40}. A"), (4, "[1]\nReferences\nno numbers"), (5, "[5] [1-4] [5-9] [11]\nLITERATURE, References\n10. A"),
    ], "doc_id long, text string")
    rows = sorted((r.doc_id, int(r.low), int(r.high), r.issue_type[9:], r.severity, int(r["index"])) for r in citations.integrity_ranges(docs).collect())
    assert rows == [
        (1, 3, 4, "missing_bibliography", "high", -1), (1, 6, 7, "missing_bibliography", "high", -3), (1, 20, 20, "unused_bibliography", "low", -5),
        (2, 3, 3, "missing_bibliography", "high", -1),
        (5, 1, 9, "missing_bibliography", "high", -1), (5, 10, 10, "unused_bibliography", "low", -11), (5, 11, 11, "missing_bibliography", "high", -10),
    ]
