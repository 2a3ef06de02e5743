"""Gates before model calls, and folds of their verdicts into sentence results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.functions.lexicons import FORMULA_WORDS

FAILURES = ("api_request_error", "json_parse_error")
SCHEMA_ISSUE = "array<struct<issue_type:string,severity:string>>"


def _issue(kind: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"))


def style_warnings(nv_ratio: Column, n_words: Column, n_verbs: Column, sentence: Column) -> Column:
    """Warnings of noun stacking, missing verbs and formulas without an explanation."""
    explained = None
    for w in FORMULA_WORDS:
        hit = F.lower(sentence).contains(w)
        explained = hit if explained is None else explained | hit
    return F.array_compact(
        F.array(
            F.when(nv_ratio > 4.5, _issue("translationese_noun_stacking", "medium")),
            F.when((n_verbs == 0) & (n_words > 8), _issue("translationese_verb_deficiency", "medium")),
            F.when(sentence.contains("__PROTECTED_LATEX") & ~explained, _issue("style_formula_unexplained", "low")),
        )
    )


def triggered(cliches: Column, chains: Column, nv: Column, nv_max: Column, passive: Column, warnings: Column) -> Column:
    return (cliches > 0) | (chains > 0) | (nv > nv_max) | (passive > 0) | (warnings > 0)


def local_route(rows: DataFrame) -> DataFrame:
    """Adds route, ppl_basis and ppl2 of a local run.

    Columns: is_bibliography, triggered, is_gap, has_model, head_ppl (of the first tokens), ppl, ppl_low, ppl_high.
    """
    early = F.expr("has_model AND NOT triggered AND head_ppl BETWEEN ppl_low AND ppl_high")
    suspicious = F.expr("triggered OR (has_model AND (ppl < ppl_low OR ppl > ppl_high))")
    route = F.when(F.col("is_bibliography"), "bibliography").when(early, "early_exit").when(F.col("is_gap"), "citation_gap").when(suspicious, "judge").otherwise("passed")
    used = F.when(F.col("has_model") & ~F.col("is_bibliography"), F.when(early, F.col("head_ppl")).otherwise(F.col("ppl")))
    return rows.withColumn("route", route).withColumn("ppl2", F.round(used, 2)).withColumn("ppl_basis", F.when(used.isNotNull(), F.when(early, "prefix").otherwise("sentence")))


def remote_route(rows: DataFrame, with_ppl: bool) -> DataFrame:
    """Adds route and ppl2 of a hybrid (with_ppl) or cloud run: all but bibliography and gaps are judged."""
    route = F.when(F.col("is_bibliography"), "bibliography").when(F.col("is_gap"), "citation_gap").otherwise("judge")
    used = F.when((F.col("has_model") & (route == "judge")) if with_ppl else F.lit(False), F.col("ppl"))
    return rows.withColumn("route", route).withColumn("ppl2", F.round(used, 2))


def folded(rows: DataFrame) -> DataFrame:
    """Adds status, issue_type, judge_error and issues of a judged sentence (issues, ppl2, ppl_low).

    A low perplexity without issues vetoes; a failure of the judge leaves the sentence unjudged.
    """
    veto = F.expr("size(found) = 0 AND ppl2 < ppl_low")
    found = F.when(veto, F.array(_issue("ai_generated_suspicion", "high"))).otherwise(F.col("found"))
    df = rows.withColumn("found", found).withColumn("issue_type", F.get("found", F.lit(0))["issue_type"])
    failed = F.coalesce(F.col("issue_type").isin(*FAILURES), F.lit(False))
    kept = F.filter("found", lambda i: ~i["issue_type"].isin(*FAILURES))
    return (
        df.withColumn("judge_error", failed)
        .withColumn("status", F.when(failed | (F.size("found") == 0), "passed").otherwise("flagged"))
        .withColumn("issues", F.when(failed, F.array().cast(SCHEMA_ISSUE)).otherwise(kept))
        .drop("found")
    )


def audited(rows: DataFrame) -> DataFrame:
    """status, issue_type and issues after a sentence's citation audits (array of statuses).

    The first audit that contradicts or lacks information flags the sentence and leads its issues.
    """
    first = F.get(F.filter("audits", lambda a: a.isin("CONTRADICTED", "NOT_ENOUGH_INFO")), F.lit(0))
    kind = F.when(first == "NOT_ENOUGH_INFO", "citation_gap").when(first == "CONTRADICTED", "citation_contradiction")
    df = rows.withColumn("_k", kind)
    lead = F.array(F.struct(F.col("_k").alias("issue_type"), F.lit("high").alias("severity")))
    rest = F.filter("issues", lambda i: i["issue_type"] != F.col("_k"))
    hit = F.col("_k").isNotNull()
    return df.withColumns({"issues": F.when(hit, F.concat(lead, rest)).otherwise(F.col("issues")), "status": F.when(hit, "flagged").otherwise(F.col("status")), "issue_type": F.coalesce("_k", "issue_type")}).drop("_k")


def tabs(rows: DataFrame) -> Column:
    """Every tab that shows a result (status, judge_error, issue_types, is_integrity)."""
    has = lambda kinds: F.exists("issue_types", lambda i: i.isin(*kinds))
    flagged = (F.col("status") == "flagged") & ~F.col("is_integrity")
    unjudged = F.col("judge_error") & (F.col("status") != "flagged")
    ai = has(("ai_generated_suspicion",))
    return F.array_compact(
        F.array(
            F.lit("all"), F.when(unjudged, "unjudged"), F.when((F.col("status") != "flagged") & ~unjudged, "passed"),
            F.when(flagged & ai, "ai"), F.when(flagged & F.exists("issue_types", lambda i: i != "ai_generated_suspicion"), "flagged"), F.when(F.col("is_integrity"), "integrity"),
        )
    )
