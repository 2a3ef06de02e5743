"""The diagnosis of documents, composed: trigger, route, judge, fold, audit, and risks after each sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.operators import risk, verdict

#: A judge gives the issues of a sentence's row, in the order found; a single failure code where it fails.
Judge = Callable[[], Column]
#: Words of a sentence beyond which the rule judge gives up, as a model with a bounded answer would.
MOST_WORDS = 80


def rule_judge() -> Column:
    """Style warnings and clichés as issues, without a model."""
    found = F.concat(
        F.transform("warnings", lambda w: F.struct(w["issue_type"].alias("issue_type"), w["severity"].alias("severity"))),
        F.when(F.col("n_cliches") > 0, F.array(F.struct(F.lit("style_cliche").alias("issue_type"), F.lit("low").alias("severity")))).otherwise(F.array().cast(verdict.SCHEMA_ISSUE)),
    )
    failed = F.array(F.struct(F.lit("json_parse_error").alias("issue_type"), F.lit("low").alias("severity")))
    return F.when(F.col("n_words") > MOST_WORDS, failed).otherwise(found)


def diagnosed(features: DataFrame, judge: Judge = rule_judge) -> DataFrame:
    """Feature rows (with nv_ratio_max, ppl_low and ppl_high of their discipline) as results: route, status,
    issue_type, issues, judge_error, ppl2, ppl_basis.

    Perplexities (ppl, head_ppl), is_bibliography and is_gap are taken where the rows have them. Only the rows on
    the route to the judge are judged; a bibliography row passes, a citation gap is flagged as such.
    """
    rows = features
    for name, value in (("is_bibliography", F.lit(False)), ("is_gap", F.lit(False)), ("ppl", F.lit(None).cast("double")), ("head_ppl", F.lit(None).cast("double"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    rows = rows.withColumn("has_model", F.col("ppl").isNotNull())
    rows = rows.withColumn("warnings", verdict.style_warnings(F.col("nv_ratio"), F.col("n_words"), F.col("n_verbs"), F.col("sentence")))
    trigger = verdict.triggered(F.col("n_cliches"), F.col("n_chains"), F.col("nv_ratio"), F.col("nv_ratio_max"), F.col("n_passive"), F.size("warnings"))
    rows = verdict.local_route(rows.withColumn("triggered", trigger))
    gap = F.array(F.struct(F.lit("citation_gap").alias("issue_type"), F.lit("high").alias("severity")))
    none = F.array().cast(verdict.SCHEMA_ISSUE)
    judged = rows.withColumn("found", F.when(F.col("route") == "judge", judge()).when(F.col("route") == "citation_gap", gap).otherwise(none))
    # The veto of a low perplexity is the judge's alone.
    judged = judged.withColumn("_ppl", F.col("ppl2")).withColumn("ppl2", F.when(F.col("route") == "judge", F.col("ppl2")))
    return verdict.folded(judged).withColumn("ppl2", F.col("_ppl")).drop("_ppl", "has_model", "warnings", "triggered")


def with_risks(results: DataFrame, key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """Results with the document's risks after each of them."""
    flags = results.withColumn("is_flagged", F.col("status") == "flagged").withColumn("is_unjudged", F.col("judge_error"))
    return risk.running_risks(flags, key, order, keep=("route", "status", "issue_type", "judge_error"), carry=True)
