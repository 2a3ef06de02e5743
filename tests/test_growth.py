"""Steps whose cost must grow no faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.operators import lookup, report, retrieval
from veracol.plans import rule_queries
from veracol.sources import reference_store


def exchanges(df) -> int:
    """Exchanges of rows in a plan, but for those of single rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return sum(line.count("Exchange hashpartitioning") + line.count("Exchange rangepartitioning") for line in plan.splitlines())


def test_postings_of_wanted_terms_alone_score_alike(spark):
    texts = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 30)) + (" rare" if i == 5 else "")) for i in range(40)]
    chunks = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, chunk string, chunk_index int")
    queries = spark.createDataFrame([(1, "rare w3"), (2, "w5 w5"), (3, "..."), (4, None)], "query_id long, query string")
    few = retrieval.wanted_postings(chunks, "doc_id", queries)
    assert {r.term for r in few.posts.select("term").distinct().collect()} == {"rare", "w3", "w5"}
    assert few.chunks.count() == 40
    rows = lambda posts, every: sorted(map(tuple, retrieval.top_k_or_first(queries, posts, every, "doc_id").collect()))
    assert rows(few.posts, few.chunks) == rows(retrieval.postings(chunks, [], "doc_id"), chunks)


def test_phrases_stand_between_word_boundaries(spark):
    texts = ["of the", "x of  the.", "often of thee", "roof the", "of\tthe", "прof the", "of theж", "of_the", "roof the of the", "𝒜of the", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "c string")
    by_pattern = F.when(F.col("c").rlike(t.phrase_pattern("of the")), F.array(F.lit("of the"))).otherwise(F.array().cast("array<string>"))
    for r in rows.select("c", t.phrases_in(F.col("c"), ("of the",)).alias("got"), by_pattern.alias("want")).collect():
        assert r.got == r.want, r.c


RESULTS = "doc_id long, idx int, text string, status string, issue_type string, severity string, ppl double, predictability_risk double, uniformity_risk double, translationese_risk double, redundancy_risk double"


def test_reports_read_their_results_once(spark):
    rows = [(1, 1, "b", "flagged", "k", "low", 2.0, 1.0, 2.0, 3.0, 4.0), (1, -1, "w", "flagged", "i", "high", None, 0.0, 0.0, 0.0, 0.0), (1, 0, "a", "passed", None, None, None, 9.0, 9.0, 9.0, 9.0), (2, -2, "v", "flagged", "i", "high", None, 0.0, 0.0, 0.0, 0.0)]
    results = spark.createDataFrame(rows, RESULTS)
    got = sorted((r.doc_id, r.seq, r.event) for r in report.events(results).collect())
    assert got == [(1, 1, "init"), (1, 2, "result"), (1, 3, "result"), (1, 4, "result"), (1, 5, "done"), (2, 1, "init"), (2, 2, "result")]
    data = {r.seq: r.data for r in report.events(results).where("doc_id = 1").collect()}
    assert data[1] == '{"sentences":2}' and '"w"' in data[2] and '"a"' in data[3] and data[5].startswith('{"predictability_risk":1.0,')
    audits = spark.createDataFrame([], "doc_id long, idx int, cite_key string, title string, status string, evidence string")
    text = {r.doc_id: r.report for r in report.markdown(results, audits).collect()}
    assert list(text) == [1] and "- `i` (high): w" in text[1] and "- 1 `k` (low), perplexity 2.00: b" in text[1]
    # Each report asks for its results once.
    for made in (report.events(results), report.markdown(results, audits), report.as_json(results, audits)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("predictability_risk#") and exchanges(made) <= 2


def test_titles_are_not_moved_to_be_looked_up(spark):
    titles = spark.createDataFrame([(i, f"common words number{i % 7} tail{i}") for i in range(200)], "a long, title string")
    requests = spark.createDataFrame([(1, "common words number3 tail10"), (2, "tail5 tail6 number9 common"), (3, "nothing")], "id long, q string")
    found = lookup.best_titles(requests, titles, "id", "q", ["a"], "title")
    assert {r.id: (r.a, r.similarity) for r in found.collect()} == {1: (10, 1.0), 2: (5, 0.5)}
    assert exchanges(found) == 1


def test_an_inverted_index_is_rebuilt_without_moving_words(spark):
    docs = spark.createDataFrame([(1, " b a  b "), (2, ""), (3, "x")], "doc_id long, text string")
    text = retrieval.rebuilt(retrieval.inverted(docs, "doc_id", "text"), "doc_id")
    assert {tuple(r) for r in text.collect()} == {(1, "b a b"), (3, "x")}
    assert exchanges(text) == 1


def test_a_version_moves_only_texts_that_may_be_replaced(spark, tmp_path):
    store = reference_store.Store(spark, f"file://{tmp_path}/store", "key long, text string")
    store.ingest(spark.createDataFrame([(1, "a"), (2, "b")], "key long, text string"), "one")
    store.ingest(spark.createDataFrame([(2, "c"), (3, "d")], "key long, text string"), "two")
    store.remove(spark.createDataFrame([(1,)], "key long"), "three")
    assert "Join" not in store.read(1)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, store.read(2).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, store.read().collect())) == [(2, "c"), (3, "d")]


def test_orders_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rule_queries, "LINES_A_TASK", 10)
    spark.range(95).selectExpr("id div 3 AS l_orderkey", "CAST(id % 3 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = rule_queries.order_texts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and ", 10), REPARTITION_BY_NUM" in plan and exchanges(rule_queries.order_texts(spark, str(tmp_path))) == 1
