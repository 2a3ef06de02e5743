"""Sentences and their feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.functions import text as t


def split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: key, sent_idx, sentence (with placeholders for protected spans)."""
    array = t.sentence_list(t.protect(F.col(text)))
    return docs.select(key, F.posexplode(array).alias("sent_idx", "sentence"))


def features(sentences: DataFrame, cliches: tuple[str, ...] = (), connectors: tuple[str, ...] = ()) -> DataFrame:
    """Adds counts of words, nouns, verbs, passives, chains, clichés and connectors.

    Without a part-of-speech model nouns are half and verbs a fifth of the words, passives and chains zero.
    """
    words = t.word_list(F.col("sentence"))
    # Columns of their own, as what is asked of them several times would be computed as often.
    low = F.col("_low")
    df = sentences.withColumns({"_words": words, "_low": F.lower("sentence")})
    df = df.withColumn("n_tokens", F.size("_words").cast("long"))
    df = df.withColumn("n_words", F.size(F.filter("_words", lambda w: ~w.startswith("__PROTECTED_"))).cast("long"))
    df = df.withColumn("n_nouns", F.expr("n_words div 2")).withColumn("n_verbs", F.expr("greatest(1L, n_words div 5)"))
    return (
        df.withColumn("nv_ratio", F.round(F.col("n_nouns").cast("decimal(20,0)") / F.col("n_verbs"), 2).cast("decimal(12,2)"))
        .withColumn("n_passive", F.lit(0).cast("long"))
        .withColumn("n_chains", F.lit(0).cast("long"))
        .withColumn("cliches", t.phrases_in(low, cliches) if cliches else F.array().cast("array<string>"))
        .withColumn("connectors", t.phrases_in(low, connectors) if connectors else F.array().cast("array<string>"))
        .withColumn("n_cliches", F.size("cliches").cast("long"))
        .withColumn("n_connectors", F.size("connectors").cast("long"))
        .withColumn("is_protected", F.expr("n_tokens > 0 AND 2 * (n_tokens - n_words) > n_tokens"))
        .drop("_words", "_low")
    )


def probe(mode: str, min_words: int = 6, smart: int = 12, fast: int = 18) -> Column:
    """Whether a sentence is worth a model call in a mode."""
    base = ~F.col("is_protected") & (F.col("n_words") >= min_words)
    limits = {"Deep Probe": F.lit(True), "Smart Probe": (F.col("n_words") >= smart) | (F.col("n_cliches") > 0), "Fast Probe": (F.col("n_words") >= fast) | (F.col("n_cliches") > 0)}
    return base & limits.get(mode, F.lit(False))


def context(rows: DataFrame, key: str, order: str, text: str, reach: int = 2) -> DataFrame:
    """Adds before and after: the neighbouring texts joined by a space."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    before = F.array_join(F.collect_list(text).over(w.rowsBetween(-reach, -1)), " ")
    after = F.array_join(F.collect_list(text).over(w.rowsBetween(1, reach)), " ")
    return rows.select(key, order, before.alias("before"), after.alias("after"))


def bibliography_flags(docs: DataFrame, headers: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences with is_bibliography: those that start at or after the bibliography's header.

    A sentence's start is where the splitting puts it: the lengths of the pieces before it, with their
    separators, and of the white space in front of it.
    """
    df = docs.select(key, F.col(text).alias("_t"), t.header_place(F.col(text), headers).alias("_header"))
    df = df.select(key, "_t", "_header", F.posexplode(F.split("_t", r"\. ")).alias("_n", "_piece"))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("_n")
    ahead = F.coalesce(F.sum(F.length("_piece") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("_piece") - F.length(F.regexp_replace("_piece", f"^{t.SPACE}+", ""))
    df = df.withColumn("_start", ahead + lead).withColumn("sentence", t.trimmed(F.col("_piece"))).where("sentence <> ''")
    df = df.withColumn("sent_idx", (F.row_number().over(w) - 1).cast("int"))
    return df.select(key, "sent_idx", "sentence", F.expr("_header >= 0 AND _start >= _header").alias("is_bibliography"))
