"""Perplexity arithmetic over rows of logits (array of double) with a target index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.operators import selection


def nll(logits: Column, target: Column) -> Column:
    """log sum exp of the row, shifted by its maximum, minus the target's logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, (target + 1).cast("int"))


def sequence_perplexity(rows: DataFrame, key: str, position: str) -> DataFrame:
    """exp of the mean nll of each sequence; 0 for sequences without a predicted token."""
    return rows.groupBy(key).agg(F.count("nll").alias("n"), F.sum("nll").alias("nll"), F.coalesce(F.exp(F.avg("nll")), F.lit(0.0)).alias("ppl"))


def early_exit(rows: DataFrame, key: str, position: str, prefix: int, low: float, high: float) -> DataFrame:
    """Perplexity of each sequence's first predicted tokens where it lies within the bounds, else of all of them.

    position counts predicted tokens from 0; a sequence exits early only if it goes on beyond the prefix.
    """
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.exp(F.avg(F.when(F.col(position) < prefix, F.col("nll")))).alias("_head"),
        F.exp(F.avg("nll")).alias("_full"),
    )
    out = (F.lit(prefix) > 0) & (F.col("n") > prefix) & F.col("_head").between(low, high)
    return sums.select(key, "n", out.alias("early_exit"), F.when(out, F.col("_head")).otherwise(F.col("_full")).alias("ppl"), F.when(out, "prefix").otherwise("sentence").alias("basis"))


def stats(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Count, mean, exact median, range and tails of the column ppl."""
    p = F.col("ppl")
    median = selection.quantile(rows, "ppl", 0.5)
    return rows.agg(
        F.count("ppl").alias("n"), F.avg("ppl").alias("mean_ppl"), F.lit(median).cast("double").alias("median_ppl"), F.min("ppl").alias("min_ppl"), F.max("ppl").alias("max_ppl"),
        F.count_if(p < low).alias("n_below"), F.count_if(p > high).alias("n_above"), F.greatest(F.lit(1.15 * high), F.max(F.least(p, F.lit(300.0)))).alias("strip_top"),
    )
