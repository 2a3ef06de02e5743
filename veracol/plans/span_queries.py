"""Queries over protected spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.operators import spans
from veracol.plans.common import Catalog, table

catalog = Catalog()

# SQL's patterns know ASCII boundaries alone; so words are put between marks first, and marks stand for boundaries.
_L, _R = "⟦", "⟧"
_LETTER = "[a-zA-Zα-ωΑ-Ω]"
_ALONE, _INDEXED = f"{_L}{_LETTER}{_R}", rf"{_L}{_LETTER}_[\p{{L}}\p{{N}}_]+{_R}"
_GROUP = rf"(?:{_ALONE}|{_INDEXED})"
_MATH = rf"{_ALONE}\s*=\s*{_L}[\p{{L}}\p{{N}}_]+{_R}|{_GROUP}\s*(?:[=<>+\-*/\s]{{1,3}}\s*(?:{_L}\d+{_R}?|{_GROUP}))+"
_FIGURE = rf"(?i){_L}(?:рис|рисунке|рисунках|табл|таблице|таблицах|уравнении|формуле|уравнениях|формулах)(?:{_R}\.?\s*{_L})?\d+{_R}(?:\.{_L}\d+{_R})*"
_FORMULA, _REFERENCE = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$", r"\[\s*\d+[\s,;\-–—\d]*\s*\]"


def _step(before: str, after: str, kind: str, pattern: str) -> str:
    """CTE: counts the kind's matches in t and names them; a name is one word."""
    named = f"regexp_replace(t, '{pattern}', '__PROTECTED_{kind}_0__', 'g')"
    return f"{after} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{pattern}')) AS n_{kind.lower()}, {named} AS t FROM {before})"


def _marked(before: str, after: str) -> str:
    words = f"regexp_replace(replace(replace(t, '{_L}', ''), '{_R}', ''), '([\\p{{L}}\\p{{N}}_]+)', '{_L}\\1{_R}', 'g')"
    return f"{after} AS (SELECT * EXCLUDE (t), {words} AS t FROM {before})"


@catalog.add(
    "span_map",
    f"""WITH d AS (SELECT doc_id, text, text AS t FROM documents), {_step("d", "a", "LATEX", _FORMULA)}, {_step("a", "b", "REF", _REFERENCE)},
{_marked("b", "m")}, {_step("m", "c", "FIG_TBL", _FIGURE)}, {_marked("c", "k")}, {_step("k", "e", "SIMPLE_MATH", _MATH)}
SELECT doc_id, n_latex, n_ref, n_fig_tbl, n_simple_math, sha256(text) AS restored_sha256, length(text) AS restored_chars FROM e""",
)
def span_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by kind of every document, and the digest of what restoring its protected form gives."""
    rows = spans.protected(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("back", spans.restored("protected"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind.lower()}")
    return rows.select("doc_id", *[count(k) for k, _ in spans.KINDS[1:]], F.sha2(F.col("back").cast("binary"), 256).alias("restored_sha256"), F.length("back").cast("long").alias("restored_chars"))
