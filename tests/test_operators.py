"""Known results of the core operators on inline rows."""

from __future__ import annotations

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from veracol.functions import lexicons as lx
from veracol.functions import model_json
from veracol.functions import text as t
from veracol.operators import citations, classify, models, perplexity, report, retrieval, risk, sentences, similarity, verdict
from veracol.sources import bibtex, documents, settings


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_sentences_keep_formulas_whole(spark):
    docs = spark.createDataFrame([(1, "A $x. y$ b [1, 2]. Second one.  . "), (2, ""), (3, None)], "doc_id long, text string")
    rows = sentences.split(docs).orderBy("sent_idx").collect()
    assert [(r.doc_id, r.sent_idx, r.sentence) for r in rows] == [(1, 0, "A __PROTECTED_LATEX__ b __PROTECTED_REF__"), (1, 1, "Second one")]


@pytest.mark.parametrize(("words", "ratio"), [(4, 2.0), (9, 4.0), (14, 3.5), (20, 2.5)])
def test_noun_verb_ratio(spark, words, ratio):
    rows = spark.createDataFrame([(1, 0, " ".join(["w"] * words))], "doc_id long, sent_idx int, sentence string")
    assert float(sentences.features(rows).first().nv_ratio) == ratio


def test_russian_phrases(spark):
    text = "следует отметить, что метод играет важную роль; однако"
    assert one(spark, t.phrases_in(F.col("c0"), lx.CLICHES), text) == ["следует отметить, что", "играет важную роль"]
    assert one(spark, t.phrases_in(F.col("c0"), lx.CONNECTORS), text) == ["однако"]
    assert one(spark, t.phrases_in(F.col("c0"), lx.CONNECTORS), "неоднако") == []


def test_gate(spark):
    rows = [(True, 20, 0), (False, 3, 0), (False, 8, 0), (False, 8, 1), (False, 14, 0)]
    df = spark.createDataFrame(rows, "is_protected boolean, n_words long, n_cliches long")
    deep, smart = ([r[0] for r in df.select(sentences.probe(m)).collect()] for m in ("Deep Probe", "Smart Probe"))
    assert deep == [False, False, True, True, True]
    assert smart == [False, False, False, True, True]
    assert not any(r[0] for r in df.select(sentences.probe("?")).collect())


def features(spark, rows):
    schema = "doc_id long, sent_idx int, n_tokens long, nv_ratio decimal(12,2), n_passive long, n_chains long, n_cliches long, n_connectors long"
    from decimal import Decimal

    return spark.createDataFrame([(d, i, w, Decimal(str(nv)), p, g, c, k) for d, i, w, nv, p, g, c, k in rows], schema)


def test_risk_values(spark):
    df = features(spark, [(1, 0, 5, 3.5, 2, 2, 0, 0), (2, 0, 5, 1.5, 0, 1, 0, 2), (3, 0, 5, 1.5, 2, 0, 0, 0), (4, 0, 5, 1.5, 0, 0, 0, 0), (4, 1, 15, 1.5, 0, 0, 0, 0)])
    got = {r.doc_id: r for r in risk.document_risks(df).collect()}
    assert got[1].translationese_risk == pytest.approx(100.0)
    assert got[4].translationese_risk == 0.0
    assert got[2].redundancy_risk == 100.0
    assert got[3].redundancy_risk == 0.0
    assert got[4].uniformity_risk == 60.0
    assert got[1].uniformity_risk == 0.0


def test_last_running_risk_is_the_document_risk(spark):
    df = features(spark, [(1, i, w, 2.5, 0, 0, w % 2, w % 3) for i, w in enumerate((4, 9, 3, 12, 7))])
    last = risk.running_risks(df).orderBy(F.desc("sent_idx")).first()
    whole = risk.document_risks(df).first()
    assert [last[r] for r in risk.RISKS] == [whole[r] for r in risk.RISKS]


def test_bibliography_rows_change_no_risk(spark):
    df = features(spark, [(1, 0, 4, 2.5, 0, 0, 1, 0), (1, 1, 9, 2.5, 0, 0, 0, 0)])
    more = df.unionByName(features(spark, [(1, 2, 50, 4.0, 3, 3, 1, 3)]))
    flagged = more.withColumn("is_bibliography", F.col("sent_idx") == 2)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(risk.running_risks(flagged)) == key(risk.running_risks(df))


def test_perplexity_risks(spark):
    rows = [(1, 12.0), (1, 11.5), (1, 12.5), (2, 10.0), (2, 20.0), (2, None)]
    got = {r.g: r for r in risk.perplexity_risks(spark.createDataFrame(rows, "g long, ppl double"), "g", 15.0).collect()}
    assert got[1].uniformity_risk == 100.0
    assert got[2].predictability_risk == 50.0


def test_uniform_logits(spark):
    rows = [(1, i, [0.0] * 100, i % 100) for i in range(10)]
    df = spark.createDataFrame(rows, "s long, position int, e array<double>, target int").withColumn("nll", perplexity.nll(F.col("e"), F.col("target")))
    assert df.agg(F.sum("nll")).first()[0] == pytest.approx(10 * math.log(100))
    out = perplexity.early_exit(df, "s", "position", 6, 15.0, 150.0).first()
    assert out.early_exit and out.basis == "prefix" and out.ppl == pytest.approx(100.0)
    sharp = df.withColumn("nll", F.lit(0.01))
    assert not perplexity.early_exit(sharp, "s", "position", 6, 15.0, 150.0).first().early_exit


def test_similarity_is_symmetric_and_one_on_itself(spark):
    g = lambda c: t.grams(F.col(c))
    a, b = "Оценка коэффициента сцепления дорожного покрытия", "Оценка коэффициентов сцепления дорожных покрытий"
    assert one(spark, t.jaccard(g("c0"), g("c1")), a, b) == one(spark, t.jaccard(g("c1"), g("c0")), a, b) > 0.45
    assert one(spark, t.jaccard(g("c0"), g("c1")), a, a) == 1.0
    assert one(spark, t.jaccard(g("c0"), g("c1")), "", a) == 0.0


def test_source_flags(spark):
    library = spark.createDataFrame([(1, "the road surface is judged by a neural network"), (2, "other")], "item_id long, text string")
    rows = [(1, 0, "The road surface is judged by a neural network"), (1, 1, "The road surface is judged by a neural network [1]"), (1, 2, "unrelated words")]
    got = {r.sent_idx: r.issue_type for r in similarity.source_flags(spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string"), library, ["doc_id", "sent_idx"], "item_id").collect()}
    assert got == {0: "citation_gap", 1: "semantic_plagiarism_risk"}


@pytest.mark.parametrize(("length", "n"), [(0, 0), (500, 1), (501, 2), (900, 3)])
def test_chunks(spark, length, n):
    got = one(spark, t.chunks("c0"), "x" * length)
    assert len(got) == n and all(len(c) <= 500 for c in got)


def test_bm25_per_scope(spark):
    chunks = spark.createDataFrame([("a", 0, "alpha beta"), ("a", 1, "gamma delta"), ("b", 0, "alpha alpha")], "key string, chunk_index int, chunk string")
    posts = retrieval.postings(chunks, ["key"], "key")
    asked = spark.createDataFrame([(1, "a", "alpha"), (2, "b", "nothing")], "query_id long, key string, query string")
    got = retrieval.top_k(asked, posts, ["key"], "key").collect()
    assert [(r.query_id, r.key, r.chunk_index) for r in got] == [(1, "a", 0)]


def test_citation_keys(spark):
    keys = lambda s: one(spark, citations.keys("c0"), s)
    assert keys("[4-6]") == keys("[4–6]") == keys("[4—6]") == ["4", "5", "6"]
    assert keys("[a2020, b2021]") == ["a2020b2021"]
    assert keys("[1 2]") == ["12"]
    assert keys("[7-5]") == []
    assert keys("[1-999999999]") == ["1", "999999999"]


def test_integrity(spark):
    text = "Body [1] and [3].\nReferences\n1. One\n2. Two"
    docs = spark.createDataFrame([(1, text), (2, "no list [1]")], "doc_id long, text string")
    got = {(r.doc_id, r.number, r.issue_type) for r in citations.integrity(docs).collect()}
    assert got == {(1, 3, "citation_missing_bibliography"), (1, 2, "citation_unused_bibliography")}


@pytest.mark.parametrize(
    ("entry", "score"),
    [("Иванов И.И. О методе // Вестник. 2020. Т. 5, № 2. С. 10–15.", 100), ("Иванов И.И. О методе // Вестник.", 45), ("Петров П. Книга о науке", 50), ("", 100)],
)
def test_format_scores(spark, entry, score):
    assert classify.format_scores(spark.createDataFrame([(entry,)], "entry string")).first().score == score


def test_verdicts(spark):
    schema = f"id long, found {verdict.SCHEMA_ISSUE}, ppl2 double, ppl_low double"
    rows = [(1, [], 7.5, 15.0), (2, [("a", "low"), ("b", "low")], 40.0, 15.0), (3, [("api_request_error", "low")], None, 15.0)]
    got = {r.id: r for r in verdict.folded(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].status, got[1].issue_type) == ("flagged", "ai_generated_suspicion")
    assert [i.issue_type for i in got[2].issues] == ["a", "b"] and got[2].issue_type == "a"
    assert got[3].status == "passed" and got[3].judge_error and got[3].issues == []


def test_model_json():
    assert model_json.cleaned('<think>why</think>{"a": 1}') == ("why", '{"a": 1}')
    assert model_json.cleaned("<think>open") == ("open", "{}")
    assert model_json.cleaned('prose</think>\n{"a": 1} end') == ("prose", '{"a": 1}')
    assert model_json.cleaned('```json\n{"a": 1}\n```') == ("", '{"a": 1}')
    assert json.loads(model_json.repaired('{"a": "cut')) == {"a": "cut"}
    assert json.loads(model_json.repaired('{"a": "x\ny"}')) == {"a": "x\ny"}
    assert json.loads(model_json.repaired('{"a": [1, 2,],}')) == {"a": [1, 2]}
    assert json.loads(model_json.repaired('{"a": [1, {"b": 2')) == {"a": [1, {"b": 2}]}
    assert model_json.repaired(" ") == "{}"
    assert model_json.parsed("{'a': True}") == {"a": True}
    assert model_json.parsed("nothing") is None


def test_judge_is_called_for_the_rows_given_and_failures_are_rows(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "junk")], "id long, prompt string")

    def call(prompt):
        if prompt == "bad":
            raise OSError("down")
        return '{"issues": [{"issue_type": "x"}]}' if prompt == "ok" else "junk"

    got = {r.id: [i.issue_type for i in r.issues] for r in models.judged(rows, ["id"], "prompt", call).collect()}
    assert got == {1: ["x"], 2: ["api_request_error"], 3: ["json_parse_error"]}


def test_evidence():
    assert models.evidence('"Some text"', ["has Some text in it"]) == "Some text"
    assert models.evidence("some, TEXT", ["has Some text"]) == "some, TEXT"
    assert models.evidence("invented", ["has Some text"]).startswith("[summary]")


def test_reports(spark):
    schema = "doc_id long, idx int, text string, status string, issue_type string, severity string, ppl double, predictability_risk double, uniformity_risk double, translationese_risk double, redundancy_risk double"
    rows = [(1, -1, "alert", "flagged", "missing", "high", None, 0.0, 0.0, 0.0, 0.0), (1, 0, "one", "flagged", "a", "low", 7.5, 80.0, 1.0, 2.0, 3.0)]
    results = spark.createDataFrame(rows, schema)
    audits = spark.createDataFrame([], "doc_id long, idx int, cite_key string, title string, status string, evidence string")
    assert "80.0%" in report.markdown(results, audits).first().report
    assert json.loads(report.as_json(results, audits).first().report)["overall_summary"] == {"total": 1, "flagged_count": 2}
    assert [r.event for r in report.events(results).orderBy("seq").collect()] == ["init", "result", "result", "done"]
    assert report.live_risks(results).first().predictability_risk == 80


def test_files(spark, tmp_path):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "[Smith2020].docx").write_bytes(archive.getvalue())
    (tmp_path / "b.txt").write_text("Plain текст", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.md").write_text("  ")
    (tmp_path / "e.txt").write_text("x" * 5000)
    got = {r.key: r for r in documents.read_files(spark, str(tmp_path), most_bytes=4000).collect()}
    assert got["smith2020"].text == "One\nTwo" and got["b"].text == "Plain текст"
    assert got["c"].text is None and got["c"].error == "UnicodeDecodeError" and "e" not in got
    chunks = documents.ingest(documents.read_files(spark, str(tmp_path)), "s1")
    assert {r.key for r in chunks.collect()} == {"smith2020", "b", "e"}


def test_bibtex_last_entry_wins(spark):
    rows = spark.createDataFrame([(1, "@a{K1, title={x}}\n@a{K1, title={y}, booktitle={B}}")], "id long, text string")
    got = bibtex.entries(rows, "id", "text", lower_keys=True).collect()
    assert [(r.cite_key, r.title, r.journal) for r in got] == [("k1", "y", "B")]


def test_settings():
    lines = ["A=1", "A=2", "# no", 'B="x # y" # z', "C = plain # note", "bad line"]
    assert settings.settings(lines, {"C": "env"}) == {"A": "1", "B": "x # y", "C": "env"}


def test_title_words_and_stems(spark):
    shared = F.size(F.array_intersect(t.title_words(F.col("c0"), lx.TITLE_STOP_WORDS), t.title_words(F.col("c1"), lx.TITLE_STOP_WORDS)))
    assert one(spark, shared, "Deep learning for road surface", "the road surface study") == 2
    assert one(spark, t.light_stem(F.col("c0"), lx.SUFFIXES), "технического") == "техни"
    assert one(spark, t.filename_key(F.col("c0")), "/a/b/[Smith2020].v1.TXT") == "smith2020.v1"


def test_gram_join_paths_agree(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdeжé") for _ in range(rnd.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    edited = lambda x: "".join(c if rnd.random() > 0.06 else rnd.choice("abcde ") for c in x)
    left = spark.createDataFrame([(i, edited(rnd.choice(texts))) for i in range(150)] + [(900, None), (901, "ab")], "id long, sentence string")
    right = spark.createDataFrame([*enumerate(texts), (900, None)], "item long, text string")
    grams = lambda x: {c[i : i + 3] for c in ["".join(ch for ch in (x or "").lower() if ch.isalnum() or ch == "_")] for i in range(len(c) - 2)}
    want = set()
    for i, a in ((r.id, grams(r.sentence)) for r in left.collect()):
        for j, b in ((k, grams(x)) for k, x in enumerate(texts)):
            if a and b and len(a & b) / len(a | b) > 0.45:
                want.add((i, j, round(len(a & b) / len(a | b), 9)))
    assert len(want) > 50
    for rows in (4096, 0):
        monkeypatch.setattr(similarity, "CARRIED_ROWS", rows)
        got = similarity.gram_join(left, right, "sentence", "text", ["id"], ["item"]).collect()
        assert {(r.id, r.item, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)


def test_bibliography_rows_carry_the_last_risks(spark):
    from veracol.operators import risk, sentences

    text = ["One two three of the four", "Five six", "entry one", "entry two"]
    rows = [(d, i, s) for d in (1, 2) for i, s in enumerate(text)]
    df = sentences.features(spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string"), ("of the",), ())
    df = df.withColumn("is_bibliography", F.expr("CASE WHEN doc_id = 1 THEN sent_idx > 1 ELSE sent_idx <> 1 END")).withColumn("is_flagged", F.expr("sent_idx <> 1"))
    got = {(r.doc_id, r.sent_idx): r for r in risk.running_risks(df, carry=True).collect()}
    assert len(got) == 8
    assert [got[1, i].predictability_risk for i in range(4)] == [100.0, 50.0, 50.0, 50.0]
    assert tuple(got[1, 3])[2:] == tuple(got[1, 1])[2:] and tuple(got[2, 0])[2:] == (0.0,) * 4
    assert risk.document_risks(df).where("doc_id = 2").first().n_sentences == 1


def test_diagnosis_routes(spark):
    from veracol.operators import diagnosis, sentences

    rows = [(1, 0, "Plain words stand here now", 20.0, 20.0, False), (1, 1, "A cliche of the sort", 20.0, 20.0, False), (1, 2, "Low one", 10.0, 10.0, False), (1, 3, "Entry", 10.0, 10.0, True), (1, 4, "No model here", None, None, False)]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string, ppl double, head_ppl double, is_bibliography boolean")
    df = sentences.features(df, ("of the",), ()).withColumns({"ppl_low": F.lit(15.0), "ppl_high": F.lit(80.0), "nv_ratio_max": F.lit(9.0)})
    got = {r.sent_idx: r for r in diagnosis.diagnosed(df).collect()}
    assert [got[i].route for i in range(5)] == ["early_exit", "judge", "judge", "bibliography", "passed"]
    assert [got[i].issue_type for i in range(5)] == [None, "style_cliche", "ai_generated_suspicion", None, None]
    assert [got[i].status for i in range(5)] == ["passed", "flagged", "flagged", "passed", "passed"]
