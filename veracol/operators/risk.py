"""Document risks, final and running. Sums stay exact (integers, decimals); each ratio divides once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def redundant() -> Column:
    """Score in tenths, so that 0.3 + 0.2 is 0.5."""
    return F.expr(
        "8 * CAST(n_cliches > 0 AS INT) + 3 * n_chains + 3 * CAST(n_passive > 1 AS INT) + 3 * CAST(nv_ratio > 3.5 AS INT)"
        " + 2 * CAST(n_connectors > 1 AS INT) >= 5"
    )


def _sums(over=None) -> dict[str, Column]:
    """The exact sums that every risk is a ratio of."""
    excess = F.expr("least(2.00, greatest(0.00, nv_ratio - 1.50)) + least(1.0, 0.5 * n_passive) * 2 + least(1.0, 0.5 * n_chains) * 2").cast("decimal(12,2)")
    each = {
        "n": F.count("n_tokens"),
        "words": F.sum("n_tokens"),
        "words2": F.sum(F.expr("n_tokens * n_tokens")),
        "excess": F.sum(F.when(F.col("n_tokens").isNotNull(), excess)),
        "redundant": F.sum(redundant().cast("long")),
        "flagged": F.sum(F.col("is_flagged").cast("long")),
        "unjudged": F.sum(F.col("is_unjudged").cast("long")),
    }
    return {f"_{k}": (v.over(over) if over is not None else v) for k, v in each.items()}


def _body_only(rows: DataFrame) -> DataFrame:
    """Bibliography rows with null measures, which no sum counts."""
    if "is_bibliography" not in rows.columns:
        return rows
    measures = [c for c in ("n_tokens", "nv_ratio", "n_passive", "n_chains", "n_cliches", "n_connectors", "is_flagged", "is_unjudged") if c in rows.columns]
    return rows.withColumns({c: F.when(~F.col("is_bibliography"), F.col(c)) for c in measures})


def _ratios() -> dict[str, Column]:
    spread = "sqrt(CAST(_n * _words2 - _words * _words AS DOUBLE)) / _n"
    risks = {
        "predictability_risk": F.expr("100 * CAST(_flagged AS DOUBLE) / greatest(1L, _n - _unjudged)"),
        "uniformity_risk": F.expr(f"CASE WHEN _n > 1 THEN greatest(0.0D, least(100.0D, (11.0D - {spread}) * 10.0D)) ELSE 0.0D END"),
        "translationese_risk": F.expr("CAST(_excess AS DOUBLE) / (_n * 6) * 100"),
        "redundancy_risk": F.expr("100 * CAST(_redundant AS DOUBLE) / _n"),
    }
    return {k: F.when(F.col("_n") == 0, 0.0).otherwise(v) for k, v in risks.items()}


RISKS = ("predictability_risk", "uniformity_risk", "translationese_risk", "redundancy_risk")


def with_status(rows: DataFrame) -> DataFrame:
    """Rows without a verdict count as judged and not flagged."""
    for c in ("is_flagged", "is_unjudged"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(False))
    return rows


def document_risks(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """The four risks of each document, from word counts (no perplexities)."""
    sums = _body_only(with_status(features)).groupBy(key).agg(*[v.alias(k) for k, v in _sums().items()])
    return sums.select(key, F.col("_n").cast("long").alias("n_sentences"), *[v.alias(k) for k, v in _ratios().items()])


def running_risks(features: DataFrame, key: str = "doc_id", order: str = "sent_idx", keep: tuple[str, ...] = (), carry: bool = False) -> DataFrame:
    """The four risks after each body sentence; with `carry` bibliography rows stay and carry the last values (zero
    before the first body row)."""
    rows = _body_only(with_status(features))
    if "is_bibliography" in rows.columns and not carry:
        rows = rows.where("NOT is_bibliography")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select(key, order, *keep, *[v.alias(k) for k, v in _sums(w).items()])
    return sums.select(key, order, *keep, *[v.alias(k) for k, v in _ratios().items()])


def perplexity_risks(rows: DataFrame, key: str, ppl_low: float) -> DataFrame:
    """Predictability and uniformity of each group's perplexities; null ones are left out."""
    n = F.count("ppl")
    low = F.count(F.when(F.col("ppl") < ppl_low, 1))
    return rows.groupBy(key).agg(
        (100 * low / F.greatest(n, F.lit(1))).alias("predictability_risk"),
        F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (30 - F.stddev_pop("ppl")) * 4))).otherwise(0.0).alias("uniformity_risk"),
    )


def ladder(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def report_level(value: Column) -> Column:
    """The report's levels."""
    return ladder(value, 70, 40)


def screen_level(value: Column) -> Column:
    """The screen's levels, which differ from the report's."""
    return ladder(value, 60, 35)
