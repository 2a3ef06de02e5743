"""Cases that were once cut short."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from veracol.llm import line_blocks, mph_dedup, near_copies, pii_crf, quality_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_dedup_links_by_text(spark, monkeypatch):
    rnd = random.Random(1)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((60, 200, 500)))]
        texts.append(words)
        for edits in (1, 2, 4, 8, 12):
            copy = list(words)
            for i in rnd.sample(range(len(words)), edits):
                copy[i] = f"x{rnd.randrange(5000)}"
            texts.append(copy)
        texts.append(words[: len(words) * 17 // 20])
        texts.append(words[: len(words) // 2])
    texts = [" ".join(w) for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if i // 8 == j // 8 and similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    for rows in (1024, 3, 5):
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_confirmed_bound():
    base = np.arange(100, dtype=np.uint64)
    assert near_copies.confirmed([base, base[:80], base[:79], np.zeros(0, np.uint64)]).tolist() == [0, 0, 0, 3]
    assert near_copies.confirmed([base, base[:79]]).tolist() == [0, 1]


def test_rows_without_id_keep_their_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, one), (None, two), (None, two), (7, one), (7, three), (7, three), (8, three + " end")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    exact = mph_dedup.kept_documents(docs)
    assert sorted((str(r.doc_id), r.text[0], len(r.text.split())) for r in exact.collect()) == [("7", "a", 60), ("7", "c", 60), ("8", "c", 61), ("None", "b", 60)]
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((str(r.doc_id), r.text[0]) for r in near.collect()) == [("7", "a"), ("7", "c"), ("None", "b")]


def test_windows_that_share_a_hash(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(most)}" for _ in range(n)) for most, n in ((3, 40), (9, 200), (30, 400), (2, 5), (900, 600))]
    want = []
    for t in texts:
        w = t.split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want.append(len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    for bits in (quality_rules._BITS, "60"):
        monkeypatch.setattr(quality_rules, "_BITS", bits)
        got = quality_rules.measured(docs).orderBy("doc_id").collect()
        assert [r.n_repeat_words for r in got] == want


def test_short_stretches_and_unclosed_heads():
    long = "text " * 100
    page = f"<body><p>{long}</p><div class=advert>buy</div><p>short close</p><div class=menu>m</div></body>"
    assert line_blocks.main_text(page) == long.strip() + "\nshort close"
    assert line_blocks.main_text("<html><head><title>T</title><script>a='<p>no'</script><body>a<p>b") == "a\nb"
    assert line_blocks.main_text("<head><title>T</title><p>b</p>") == "b"
    assert line_blocks.main_text("<head><noscript><div>n</div></noscript></head><p>b</p>") == "b"
    assert line_blocks.main_text("<head><title>T") == ""


def test_tokens_without_a_twin_become_spans():
    chain = np.zeros((5, 5))
    chain[4, 4] = 5.0
    text = "+1 (456) 5552186, 145/655/52187 x9"
    assert pii_crf.added_spans(text, pii_crf.base_spans(text), pii_crf.Field(np.zeros((pii_crf.N_FEATURES, 5)), chain, 0.0)) == [("phone", 18, 31)]


def test_history_index_is_kept_and_extended(spark):
    from pyspark.sql import functions as F

    from veracol.llm.common import written

    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    old = mph_dedup.winners(mph_dedup.digested(rows((5, "a"), (9, "b"), (None, "c"), (6, "a b"))))
    index = written(mph_dedup.built(old, 16), "kept_index")
    new = rows((3, "a"), (11, "b"), (4, "c"), (2, "d"), (8, "d"), (7, "a\tb"), (10, None), (12, ""))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in mph_dedup.grouped(new, index, 16).collect()}
    assert got == {(3, 3, 2, True), (11, 9, 2, False), (4, 4, 2, True), (2, 2, 2, True), (8, 2, 2, False), (7, 6, 2, False), (10, 10, 2, True), (12, 10, 2, False)}
    after = mph_dedup.merged(index, mph_dedup.winners(mph_dedup.digested(new)), 16)
    assert after.agg(F.sum("n")).first()[0] == 12 and after.count() == 6 and after.where("repeat").count() == 4
    again = written(mph_dedup.built(after.drop("repeat"), 16), "kept_index")
    assert mph_dedup.grouped(rows((1, "d")), again, 16).first().group_size == 3


def test_extra_columns_never_clash(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, one, "en", "a", 1), (2, one, "en", "a", 1), (3, two, "en", "b", 1)], SCHEMA)
    for name in ("_keep", "_taken", "_copies", "_copy", "_row", "_digest", "node", "bands", "digest", "row", "label"):
        docs = docs.withColumn(name, docs.doc_id + 1)
    assert sorted(tuple(r) for r in mph_dedup.kept_documents(docs).collect()) == sorted(tuple(r) for r in docs.where("doc_id <> 2").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    mix = corpus_pipeline.mixing(spark, docs, "")
    assert mix.columns == docs.columns and mix.count() > 0


@pytest.mark.parametrize("weights", [(3, 1, 2), (4, 3), (5,)])
def test_targets_at_any_weights(spark, weights):
    from fractions import Fraction

    from veracol.llm import source_mixing

    rnd = random.Random(4)
    for _ in range(4):
        sizes = [(f"s{i:02}", rnd.choice((0, 1, 10, 1000, 9999))) for i in range(7)]
        rows = source_mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), weights).collect()
        got = {r.source: r.target for r in rows}
        w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
        left, free, want = Fraction(3 * sum(n for _, n in sizes), 2), dict(sizes), {}
        while free:
            share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * free[s]]
            if not over:
                want |= share
                break
            for s in over:
                want[s] = Fraction(2 * free.pop(s))
                left -= want[s]
        assert got == pytest.approx({s: float(x) for s, x in want.items()})


def test_rows_of_one_id_mix_apart(spark):
    from veracol.llm import source_mixing

    rows = [(1, "w " * n, "en", "a", 1) for n in (5, 50, 500)] + [(2, "x " * 9, "en", "b", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = source_mixing.mixed_documents(docs)
    want = sum(r.copies * r["size"] for r in source_mixing.mixed(docs).collect())
    assert sum(len(r.text.split()) for r in mix.collect()) == want


def test_large_groups_are_compared_whole(spark, monkeypatch):
    """Chains of links across blocks, against all pairs."""
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(6):
        now = list(words)
        for _ in range(14):
            texts.append(" ".join(now))
            for i in rnd.sample(range(len(now)), 2):
                now[i] = f"x{rnd.randrange(5000)}"
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 7)
    assert sorted(r.doc_id for r in near_copies.kept_documents(docs).collect()) == sorted(set(root))


def test_a_batch_counts_once_whoever_publishes_it(spark, monkeypatch):
    from veracol.llm import token_rollups

    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, None, None, None, 0)], SCHEMA)
    deltas = token_rollups.deltas(token_rollups.counted(docs))
    thrice = token_rollups.deltas(token_rollups.counted(docs.union(docs).union(docs)))
    ledger = token_rollups.Ledger.new(spark)
    # Both writers look before either has published; the second one comes late with other rows.
    with monkeypatch.context() as m:
        m.setattr(token_rollups.Ledger, "holds", lambda self, batch_id: False)
        assert ledger.commit("b", deltas)
        once = {tuple(r) for r in ledger.totals().collect()}
        assert not ledger.commit("b", thrice)
    assert {tuple(r) for r in ledger.totals().collect()} == once
    assert sum(r[3] for r in once if r[2] == "words-1") == 2
    # Rows of a lost writer, from before or after, are of no batch.
    deltas.write.parquet(f"{ledger.path}/data/attempt=00000000000000000000")
    deltas.write.parquet(f"{ledger.path}/data/attempt=zzzzzzzzzzzzzzzzzzzz")
    assert {tuple(r) for r in ledger.totals().collect()} == once
    other = ledger.compact(f"{ledger.path}-compacted")
    assert {tuple(r) for r in other.totals().collect()} == once


def test_compacting_keeps_the_ids(spark):
    from veracol.llm import token_rollups

    deltas = token_rollups.deltas(token_rollups.counted(spark.createDataFrame([(1, "a b c", "en", "s", 1)], SCHEMA)))
    ledger = token_rollups.Ledger.new(spark)
    names = ["b1", "of / some % kind + é", "_hidden", ".dot", "x" * 400, ""]
    assert all(ledger.commit(n, deltas) and not ledger.commit(n, deltas) for n in names)
    assert {r.batch_id for r in ledger.entries().collect()} == set(names)
    once = ledger.compact(f"{ledger.path}-1")
    assert ledger.commit("later", deltas) and not once.holds("later")
    assert once.commit("later", deltas)
    twice = once.compact(f"{ledger.path}-2")
    for n in [*names, "later"]:
        assert not twice.commit(n, deltas)
    rows = {tuple(r) for r in twice.totals().collect()}
    assert {r[:3] + (r[3] // 7, r[4] // 7) for r in rows} == {tuple(r) for r in deltas.collect()} and all(r[3] == 7 for r in rows)
    assert twice.commit("new", deltas)


def test_a_vocabulary_as_a_tokenizer_version(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from veracol.llm import token_rollups

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello  wörld <|endoftext|> 12345", "en", "s", 1), (2, None, "en", "s", 1), (3, "", None, "t", 1)]
    counts = token_rollups.bpe_counted(spark.createDataFrame(rows, SCHEMA), "bpe-50k", path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.n for r in counts.collect()} == {i: len(plain.encode_ordinary(t or "")) for i, t, *_ in rows}
    ledger = token_rollups.Ledger.new(spark)
    assert ledger.commit("b", token_rollups.deltas(counts))
    assert {tuple(r)[:4] for r in ledger.totals().collect()} == {("s", "en", "bpe-50k", 2), ("t", None, "bpe-50k", 1)}
