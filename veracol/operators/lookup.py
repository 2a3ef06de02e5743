"""Metadata lookup against a catalogue of titles: the title that a request holds most of.

How well a title fits is the share of its words that the request has, which is not symmetric. A title that reaches the
bound shares at least one of its rarest words, as many as may be missing and one more; so titles are listed under
these alone, requests under all of their words, and pairs that meet are compared in full where they meet first. Rare is
what few requests have, by a fixed number of buckets; so titles needn't be counted, and words that no request has drop out.

Defined cases: words are those that tell titles (three characters or more, no stop words), each once; titles or requests
without any match nothing; of equals the first by key wins; requests below the bound have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracol.functions import lexicons as lx
from veracol.functions import text as t
from veracol.operators.similarity import bucket, bucket_counts
from veracol.sources.stored import scratch, stored

#: Fixed value: least share of a title's words.
LEAST = 0.45


def best_titles(requests: DataFrame, titles: DataFrame, key: str, query: str, title_key: list[str], title: str, least: float = LEAST) -> DataFrame:
    """key, the title's key, title and similarity of the best title for each request."""
    asked = requests.select(key, t.title_words(F.col(query), lx.TITLE_STOP_WORDS).alias("_q")).where(F.size("_q") > 0)
    # Stored, so that the planner knows how many there are.
    asked = stored(asked, scratch(requests.sparkSession, "requests"))
    often = bucket_counts(asked.select(F.explode("_q").alias("_word")), "_word")
    known = titles.select(*title_key, title, t.title_words(F.col(title), lx.TITLE_STOP_WORDS).alias("_t"))
    # Words by how many requests may have them. So many may be missing at most, and one more must be there; those that no
    # request has can't meet any.
    reach = F.size("_t") - F.ceil(F.size("_t") * least - 1e-9).cast("int") + 1
    ranked = F.sort_array(F.transform("_t", lambda w: F.struct(F.get(often, bucket(w)).alias("f"), w.alias("w"))))
    rows = known.where(F.size("_t") > 0).select(*title_key, title, "_t", reach.alias("_reach"), ranked.alias("_ranked"))
    rare = F.transform(F.filter(F.slice("_ranked", F.lit(1), F.col("_reach")), lambda x: x["f"] > 0), lambda x: x["w"])
    rows = rows.select(*title_key, title, "_t", rare.alias("_rare"))
    met = rows.select(*title_key, title, "_t", "_rare", F.explode("_rare").alias("_word")).join(asked.select(key, "_q", F.explode("_q").alias("_word")), "_word")
    # A pair that meets on several words counts where it meets first.
    met = met.where(F.get(F.array_intersect("_rare", "_q"), F.lit(0)) == F.col("_word"))
    share = F.size(F.array_intersect("_q", "_t")) / F.size("_t")
    pairs = met.select(key, *title_key, title, share.alias("similarity")).where(F.col("similarity") >= least)
    top = pairs.groupBy(key).agg(F.min(F.struct((-F.col("similarity")).alias("_s"), *title_key, title, "similarity")).alias("_b"))
    return top.select(key, "_b.*").drop("_s")
