"""Dictionaries and rule tables joined to rows: writing rules of a discipline, lemmas, and a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracol.functions.lexicons import DEFAULT_DISCIPLINE


def discipline_rules(rows: DataFrame, rules: DataFrame, default: tuple[list[str], list[str]], key: str = "discipline") -> DataFrame:
    """Rows with do_rules and dont_rules: those of their discipline; of the universal one where the table lacks the
    discipline; of the first cluster where that one is empty or missing; the default where the table is empty.

    rules: cluster, place (of the cluster in the table), do_rules, dont_rules (arrays).
    """
    table = rules.select("cluster", "place", F.struct("do_rules", "dont_rules").alias("_rules"), (F.size("do_rules") + F.size("dont_rules") > 0).alias("_full"))
    own = table.select(F.col("cluster").alias(key), F.col("_rules").alias("_own"), F.col("_full").alias("_own_full"))
    rest = table.agg(
        F.max(F.when((F.col("cluster") == DEFAULT_DISCIPLINE) & F.col("_full"), F.col("_rules"))).alias("_universal"),
        F.min_by("_rules", "place").alias("_first"),
    )
    joined = rows.join(own, key, "left").crossJoin(F.broadcast(rest))  # one row
    chosen = F.when(F.col("_own").isNotNull(), F.when(F.col("_own_full"), F.col("_own"))).otherwise(F.col("_universal"))
    for name, words in zip(("do_rules", "dont_rules"), default, strict=True):
        given = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        joined = joined.withColumn(name, F.coalesce(chosen.getField(name), F.col("_first").getField(name), given))
    return joined.select(*rows.columns, "do_rules", "dont_rules")


def lemmatised(rows: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: the lower-cased text with each run of Cyrillic letters replaced by its lemma, itself where the
    dictionary (word, lemma; one row a word) lacks it. Other characters stay."""
    low = F.lower(text)
    runs = rows.select(key, F.split(low, "[а-яё]+").alias("_gaps"), F.regexp_extract_all(low, F.lit("([а-яё]+)"), 1).alias("_words"))
    placed = runs.select(key, F.posexplode("_words").alias("_at", "word"))
    found = placed.join(dictionary.select("word", F.col("lemma")), "word", "left").select(key, F.struct("_at", F.coalesce("lemma", "word").alias("w")).alias("_x"))
    lemmas = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["w"]).alias("_lemmas"))
    joined = runs.join(lemmas, key, "left").withColumn("_lemmas", F.coalesce("_lemmas", F.array().cast("array<string>")))
    pieces = F.zip_with("_gaps", "_lemmas", lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit(""))))
    return joined.select(key, F.array_join(pieces, "").alias("text"))
