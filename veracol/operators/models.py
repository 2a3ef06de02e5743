"""Model calls with an injected callable, made once a row in batches, behind a filter; failures become rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.functions.model_json import cleaned, parsed

ISSUES = "array<struct<issue_type:string,severity:string,explanation:string,suggestion:string>>"
STATUSES = ("SUPPORTED", "CONTRADICTED", "NOT_ENOUGH_INFO")


def style_prompt(rules: Column, before: Column, sentence: Column, after: Column, stats: Column) -> Column:
    """What a style judge is asked about a sentence."""
    return F.concat_ws("\n", F.concat(F.lit("Rules: "), rules), F.concat(F.lit("Statistics: "), stats), F.concat(F.lit("Before: "), before), F.concat(F.lit("Sentence: "), sentence), F.concat(F.lit("After: "), after))


def evidence_prompt(claim: Column, snippets: Column) -> Column:
    """What an evidence judge is asked: the claim and numbered snippets."""
    numbered = F.transform(snippets, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s))
    return F.concat_ws("\n", F.concat(F.lit("Claim: "), claim), F.array_join(numbered, "\n"))


def _verdict(answer: str | None, error: str | None) -> list[dict]:
    failure = lambda kind, text: [{"issue_type": kind, "severity": "low", "explanation": text, "suggestion": ""}]
    if error is not None:
        return failure("api_request_error", error)
    found = parsed(answer or "")
    if found is None:
        return failure("json_parse_error", (answer or "")[:40])
    return [{k: str(i.get(k) or "") for k in ("issue_type", "severity", "explanation", "suggestion")} for i in found.get("issues", []) if isinstance(i, dict)]


def judged(rows: DataFrame, key: list[str], prompt: str, call: Callable[[str], str]) -> DataFrame:
    """key, think, issues (JSON) of each prompt. Filter rows before, since every row is a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for text in frame[prompt]:
                try:
                    answers.append(call(text))
                    errors.append(None)
                except Exception as error:
                    answers.append(None)
                    errors.append(str(error)[:80])
            out = frame[key].copy()
            out["think"] = [cleaned(a)[0] if a else "" for a in answers]
            out["issues"] = [json.dumps(_verdict(a, e), ensure_ascii=False) for a, e in zip(answers, errors, strict=True)]
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", think string, issues string"
    out = rows.select(*key, prompt).mapInPandas(run, schema)
    return out.withColumn("issues", F.from_json("issues", ISSUES))


def _plain(text: str) -> str:
    return re.sub("[^a-zA-Z0-9а-яА-ЯёЁ]", "", text).lower()


def evidence(quote: str, snippets: list[str]) -> str:
    """The quote if a snippet has it, as it stands or without punctuation and case; else marked as a summary."""
    quote = quote.strip().strip("\"'").strip()
    if not quote or any(quote in s for s in snippets) or _plain(quote) and any(_plain(quote) in _plain(s) for s in snippets):
        return quote
    return f"[summary] {quote}"


def audited(rows: DataFrame, key: list[str], claim: str, snippets: str, call: Callable[[str], str] | None) -> DataFrame:
    """key, status, explanation, evidence of each claim: without snippets there is not enough information,
    without a model or with a failing one the audit failed."""
    asked = rows.withColumn("_prompt", evidence_prompt(F.col(claim), F.col(snippets)))
    none = F.coalesce(F.size(snippets), F.lit(0)) < 1
    empty = lambda df, status: df.select(*key, F.lit(status).alias("status"), F.lit("").alias("explanation"), F.lit("").alias("evidence"))
    without = empty(asked.where(none), "NOT_ENOUGH_INFO")
    if call is None:
        return without.unionByName(empty(asked.where(~none), "AUDIT_FAILED"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            status, why, quotes = [], [], []
            for text, own in zip(frame["_prompt"], frame[snippets], strict=True):
                try:
                    found = parsed(call(text)) or {}
                    named = str(found.get("status", ""))
                    status.append(named if named in STATUSES else "AUDIT_FAILED")
                    why.append(str(found.get("explanation") or ""))
                    quotes.append(evidence(str(found.get("evidence") or ""), list(own)))
                except Exception as error:
                    status.append("AUDIT_FAILED")
                    why.append(str(error)[:40])
                    quotes.append("")
            yield frame[key].assign(status=status, explanation=why, evidence=quotes)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", status string, explanation string, evidence string"
    return without.unionByName(asked.where(~none).mapInPandas(run, schema))


def or_else(answers: DataFrame, fallback: DataFrame, key: str, value: str, valid: list[str]) -> DataFrame:
    """A model's value where it is valid, else the rule's."""
    named = answers.where(F.col(value).isin(*valid)).select(key, F.col(value).alias("_m"))
    return fallback.join(named, key, "left").withColumn(value, F.coalesce("_m", value)).drop("_m")
