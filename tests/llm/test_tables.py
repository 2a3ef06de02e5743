"""Operators over tables with nulls, ties, repeated rows, clashing columns and no rows, against plain versions."""

from __future__ import annotations

import collections
import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veracol.llm import byte_bpe, chat_format, line_blocks, mph_dedup, pii_crf, quality_rules, simhash_gray, source_mixing, token_rollups, toxicity

VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
LONG = "the cat sat on a mat and " * 3000
ROWS = [
    (1, "the quick brown fox of the old town and the sea " * 3 + "x1 x2 x3 x4 x5 x6 x7 x8 x9 and so on to the end of it all " * 2, "en", "a", 1),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "de", "b", 3), (5, "q  z", "en", "b", 4), (6, "q z", "en", "b", 3), (6, "q z", "en", "b", 3),
    (None, "q\nz", None, "c", 3), (8, LONG, "en", "c", len(LONG)), (9, "mail me at a.b@c.de or 10.0.0.1", "fr", "a", 0), (10, "ONE", "en", "", 3), (11, "one", "en", None, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that operators add by the same names.
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("fp", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("n_words", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed
    assert got[8].n_repeat_words == got[8].n_words == 21000 and got[8].base_failed
    assert quality_rules.kept_documents(docs).columns == docs.columns
    assert quality_rules.judged(empty).count() == 0


def test_exact_dedup(docs, empty):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in mph_dedup.grouped(docs).collect())
    assert got[6, 5, 4, False] == 2 and got[None, 5, 4, False] == 1 and got[5, 5, 4, True] == 1
    assert got[2, 2, 2, True] == 1 and got[3, 2, 2, False] == 1 and got[4, 4, 1, True] == 1
    assert sum(got.values()) == len(ROWS)
    assert mph_dedup.grouped(empty).count() == 0
    assert sorted(r.doc_id for r in mph_dedup.kept_documents(docs).collect()) == [1, 2, 4, 5, 8, 9, 10, 11]


def test_near_dedup(docs, empty):
    rows = simhash_gray.grouped(docs).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(ROWS)
    assert got[2] == got[3] == got[4] == 2 and got[None] == got[6] == got[5] == 5 and got[11] == got[10] == 10
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert simhash_gray.grouped(empty).count() == 0


def test_mixing(docs, empty):
    rows = source_mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    source, by, target = {r[0]: r[3] for r in ROWS}, collections.Counter(), {}
    for r in rows:
        by[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(by[s] - x) < 1 for s, x in target.items())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, source_mixing.mixed(docs).collect()), key=repr)
    assert source_mixing.mixed(empty).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r for r in source_mixing.targets(sizes).collect()}
    assert got["a"].target == 20.0 and got["a"].epochs == 2 and got["a"].budget == 0
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * 2015)
    assert all(r.target <= 2 * r.source_size for r in got.values())


def test_tokens(docs, empty):
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in byte_bpe.round_trips(docs, *VOCABULARY).collect()}
    own = byte_bpe.codec(*VOCABULARY)
    assert got == {(i, len(own.encode([x or ""])[0]) // 4, hashlib.sha256((x or "").encode()).hexdigest()) for i, x, *_ in ROWS}
    both = byte_bpe.decoded(byte_bpe.encoded(docs, *VOCABULARY, keep=("doc_id", "text")), *VOCABULARY)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    assert byte_bpe.round_trips(empty, *VOCABULARY).count() == 0


def test_personal_data(docs, empty):
    got = {r.doc_id: r for r in pii_crf.counted(docs).collect()}
    assert (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 0, 0)
    assert got[9].spans.startswith("email:11:19,ip:23:31")
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert pii_crf.counted(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0, 1), (9, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.held_out_scores(empty, labels).count() == 0
    assert toxicity.held_out_scores(docs, labels.limit(0)).count() == len(ROWS)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>a&amp;b</p>")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert sorted((r.text, r.n_chars) for r in line_blocks.extracted(pages).collect()) == [("", 0), ("", 0), ("a&b", 3)]
    assert line_blocks.extracted(pages.limit(0)).count() == 0


def test_conversations(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", bad), (-7, 1, "assistant", bad), (8, 0, None, None), (8, 0, "assistant", "a\\<s>\\\\"), (8, 0, "assistant", "a\\<s>\\\\"), (8, None, "x[ROLE]", "[\\INST]"), (None, 3, "assistant", "é ▁\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    made = chat_format.formatted(turns, *VOCABULARY)
    got = {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(made, *VOCABULARY).collect()}
    groups = collections.defaultdict(list)
    for c, n, role, text in rows:
        groups[c].append(((n is not None, n or 0), role or "", text or ""))
    want = set()
    for c, turns_ in groups.items():
        turns_.sort()
        learnt = "".join(t for _, r, t in turns_ if r == "assistant")
        want.add((c, len(turns_), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns_).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    assert got == want
    assert chat_format.read_back(chat_format.formatted(turns.limit(0), *VOCABULARY), *VOCABULARY).count() == 0


def test_rollups(spark, docs, empty):
    ledger = token_rollups.Ledger.new(spark)
    assert ledger.totals().count() == 0
    counts = token_rollups.counted(docs)
    assert ledger.commit("b1", token_rollups.deltas(counts)) and not ledger.commit("b1", token_rollups.deltas(counts))
    assert ledger.commit("none", token_rollups.deltas(token_rollups.counted(empty)))
    total = ledger.totals().where("tokenizer_version = 'words-1'").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert tuple(total) == (len(ROWS), sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS))
    assert ledger.commit("b2", token_rollups.deltas(counts, -1)) and ledger.totals().count() == 0


def test_pipeline(spark, tmp_path):
    words = lambda seed: " ".join(f"w{(seed * 7919 + i * 31) % 1000} the" for i in range(80))
    rows = [(i, words(i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, words(1), "en", "s1", 1), (101, words(2).replace("w", "w", 1) + " end", "en", "s2", 1), (102, "short", "en", "s0", 1), (103, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= set(range(30))
    assert all(r.n_tokens == len(r.ids) for r in out)
