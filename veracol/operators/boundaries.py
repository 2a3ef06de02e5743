"""Sentence boundaries that know abbreviations, learned from the texts themselves without labels (Kiss and Strunk, 2006).

Words are counted with and without a full stop behind them. A word is an abbreviation where the stop clings to it far
more than to words at large: a log-likelihood ratio, weighted for short words with stops inside and against words
that also stand without one. Words that follow true ends far more often than chance are starters: after them even an
abbreviation's stop ends a sentence. Both tables are joined with the candidate ends, so that their size doesn't matter.

Defined cases: null and blank texts have no sentences; words without a letter are never abbreviations; a corpus
without any stop has neither table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.sources.stored import scratch, stored

#: How likely a stop follows an abbreviation; least scores of abbreviations and of starters.
CLINGS, LEAST_ABBREVIATION, LEAST_STARTER = 0.99, 0.3, 30.0


def _ends(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, last, next: the words on both sides of each candidate end, without the texts between."""
    rows = docs.select(key, F.split(text, r"\. ").alias("_p")).where("size(_p) > 1")
    rows = rows.select(key, F.transform("_p", t.word_list).alias("_w"))
    sides = lambda w, i: F.struct(F.lower(F.try_element_at(w, F.lit(-1))).alias("last"), F.lower(F.get(F.get("_w", i + 1), F.lit(0))).alias("next"))
    rows = rows.select(key, F.posexplode(F.transform("_w", sides)).alias("n", "_s"))
    return rows.select(key, "n", "_s.last", "_s.next")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (lower case, without its last stop), total, stops: how often it stands at all, and before a stop."""
    # Counted as they stand first, so that few are changed.
    words = docs.select(F.explode(t.word_list(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    plain = F.lower(F.when(F.col("w").endswith("."), F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")))
    return words.groupBy(plain.alias("word")).agg(F.sum("k").alias("total"), F.sum(F.when(F.col("w").endswith("."), F.col("k")).otherwise(0)).alias("stops"))


def _with_sums(counts: DataFrame, **sums: Column) -> DataFrame:
    """Adds sums over all rows, from one row."""
    return counts.crossJoin(F.broadcast(counts.agg(*[v.alias(k) for k, v in sums.items()])))


def abbreviations(counts: DataFrame) -> DataFrame:
    """word and score of the abbreviations."""
    rows = _with_sums(counts, n=F.sum("total"), n_stops=F.sum("stops")).where("stops > 0 AND n_stops < n").where(F.col("word").rlike(r"\p{L}"))
    p, without = F.col("n_stops") / F.col("n"), F.col("total") - F.col("stops")
    ratio = -2 * (F.col("stops") * F.log(p) + without * F.log(1 - p) - F.col("stops") * F.log(F.lit(CLINGS)) - without * F.log(F.lit(1 - CLINGS)))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    # Once in the exponent's reach, more occurrences without a stop change nothing.
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters, -F.least(without, F.lit(300)).cast("double"))
    return rows.select("word", score.alias("score")).where(F.col("score") >= LEAST_ABBREVIATION)


def starters(ends: DataFrame, counts: DataFrame, found: DataFrame) -> DataFrame:
    """word and score of the words that open sentences, by the ends that no abbreviation casts doubt on."""
    pairs = ends.where("next IS NOT NULL").groupBy("last", "next").agg(F.count(F.lit(1)).alias("k"))
    sure = pairs.join(found.select(F.col("word").alias("last")), "last", "left_anti")
    at_start = sure.groupBy(F.regexp_replace("next", r"\.$", "").alias("word")).agg(F.sum("k").alias("starts"))
    ends = at_start.agg(F.sum("starts").alias("ends"))
    rows = at_start.join(_with_sums(counts, n=F.sum("total")), "word").crossJoin(F.broadcast(ends)).where("ends < n AND starts < n").where(F.col("word").rlike(r"\p{L}"))
    both, rest, n = F.least("starts", "total"), F.greatest(F.col("total") - F.col("starts"), F.lit(0)), F.col("n")
    p, p1, p2 = F.col("total") / n, both / F.col("ends"), rest / (n - F.col("ends"))
    like = lambda k, m, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(m > 0, m * F.log(1 - q)).otherwise(0.0)
    ends_, others = F.col("ends"), n - F.col("ends")
    ratio = 2 * (like(both, ends_ - both, p1) + like(rest, others - rest, p2) - like(both, ends_ - both, p) - like(rest, others - rest, p))
    return rows.select("word", ratio.alias("score")).where((p1 > p2) & (F.col("score") >= LEAST_STARTER))


def split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_idx, sentence: candidate ends but for those that an abbreviation's stop makes.

    Only the ends that don't count are brought to their texts, which are cut in place. Counts and tables are stored, so that
    texts are counted once and the planner knows how small the tables are. A key names one text.
    """
    folder = scratch(docs.sparkSession, "boundaries")
    ends, counts = _ends(docs, key, text), stored(word_counts(docs, text), f"{folder}/counts")
    found = stored(abbreviations(counts).select("word"), f"{folder}/abbreviations")
    opening = stored(starters(ends, counts, found).select(F.col("word").alias("_starter")), f"{folder}/starters")
    short = ends.join(found.select(F.col("word").alias("last")), "last", "left_semi")
    short = short.join(opening, F.regexp_replace("next", r"\.$", "") == F.col("_starter"), "left_anti")
    passed = stored(short.groupBy(F.col(key).alias("_key")).agg(F.collect_set("n").alias("_passed")), f"{folder}/passed")
    rows = docs.select(key, F.split(text, r"\. ").alias("_p")).where("_p IS NOT NULL").join(passed, F.col(key).eqNullSafe(F.col("_key")), "left")
    starts = F.expr("filter(sequence(0, size(_p) - 1), i -> i = 0 OR NOT array_contains(_passed, i - 1))")
    rows = rows.select(key, "_p", F.when(F.col("_passed").isNotNull(), starts).alias("_starts"))
    joined = F.expr("transform(_starts, (s, j) -> array_join(slice(_p, s + 1, coalesce(get(_starts, j + 1), size(_p)) - s), '. '))")
    rows = rows.select(key, F.when(F.col("_starts").isNull(), F.col("_p")).otherwise(joined).alias("_s"))
    return rows.select(key, F.posexplode(F.filter(F.transform("_s", t.trimmed), lambda s: s != "")).alias("sent_idx", "sentence"))
