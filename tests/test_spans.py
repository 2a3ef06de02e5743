"""Span protection against Python's patterns, and back."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from veracol.operators import spans

DATA = "/root/testdata/sf0.001"
CASES = [
    "x = $a$ and [1, 2] рис. 3.4 y a", "__PROTECTED_REF_0__ [3] __PROTECTED_LATEX_", "$$a\nb$$ $c$ $ d", "Рис.5 и ТАБЛИЦЕ 7.1.2, рисунка 5", "éa = 5, a_1 + b - 7 * c", "a a a. b = c", "[1-3; 4] [x] [ 12 – 14 ]",
    "no span. at all", "", None, "$" * 7, "__PROTECTED__PROTECTED_REF_1__[1]", "_[1]_[2]_", "a = __PROTECTED_LATEX_0__", "x " * 5_000 + "$y$. " * 3_000, "α = β + γ_1", "[1].[2]. [3]", "рис. 1" + ".1" * 50_000, "рис. 5.6abc табл 5abc", "a" + " + b" * 50_000,
]


def plain(text):
    """Protected form and originals by number, kind after kind."""
    originals = []

    def name(kind):
        def give(m):
            originals.append((kind, m.group(0)))
            return f"__PROTECTED_{kind}_{len(originals) - 1}__"

        return give

    for kind, pattern in spans.KINDS:
        pattern = pattern.replace(r"(?:\.\d+\b)*+", r"(?:\.\d+)*").replace("))++", "))+")
        text = re.sub(pattern, name(kind), text)
    return text, originals


def test_cases(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = spans.protected(docs).withColumn("back", spans.restored("protected")).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert r.back == r.text
        if r.text is not None:
            assert (r.protected, [tuple(s) for s in r.spans]) == plain(r.text), r.text


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
def test_every_document(spark):
    rows = spans.protected(spark.read.parquet(f"{DATA}/documents.parquet")).withColumn("back", spans.restored("protected")).collect()
    assert sum(len(r.spans) for r in rows) > 0
    for r in rows:
        assert r.back == r.text and (r.protected, [tuple(s) for s in r.spans]) == plain(r.text)


def test_sentences_keep_their_originals(spark):
    text = "First $a. b$ here. See [1]. [2] and x = $c. d$. Last __PROTECTED_REF_9__"
    rows = spans.sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("sent_idx").collect()
    assert [r.original for r in rows] == ["First $a. b$ here", "See [1]", "[2] and x = $c. d$", "Last __PROTECTED_REF_9__"]
    assert ["$" in r.sentence or "[" in r.sentence for r in rows] == [False] * 4


def test_names_that_no_text_gave_stay(spark):
    given = [("__PROTECTED_REF_7__ __PROTECTED_REF_0__ __PROTECTED_LATEX_0__ __PROTECTED_REF_99999999999__",)]
    df = spark.createDataFrame(given, "s string").selectExpr("s", "array(named_struct('kind', 'REF', 'original', '[1]')) AS spans")
    assert df.select(spans.restored("s").alias("b")).first().b == "__PROTECTED_REF_7__ [1] __PROTECTED_LATEX_0__ __PROTECTED_REF_99999999999__"
