"""Protected spans: what style rules must not see is named, and every name leads back to what it stands for.

Kinds are protected one after another, as later ones may hold names of earlier ones (`x = $a$`), and numbered through
the whole text. A text that holds a name literally has that protected first, so that a name in a protected text is
always one that was given. Restoring goes through the kinds backwards. All of it is column expressions.

Defined cases: null stays null; a text without spans is its own protected form; a name that is cut in two, or whose
number the text never gave, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.functions import text as t

# Kinds in order, with their patterns; classes and boundaries are those of all scripts. Repeated groups are
# possessive, which matches the same here, as else a long run of them would exhaust the engine's stack.
KINDS = (
    ("LITERAL", r"__PROTECTED_\w*"),
    ("LATEX", r"\$\$[\s\S]+?\$\$|\$[^\$\n]+?\$"),
    ("REF", r"\[\s*\d+(?:[\s,;\-–—\d]*)\s*\]"),
    ("FIG_TBL", r"(?i)\b(?:рис|рисунке|рисунках|табл|таблице|таблицах|уравнении|формуле|уравнениях|формулах)\.?\s*\d+(?:\.\d+\b)*+\b"),
    # A letter and what may follow it are looked at first: boundaries cost more, and most places have none of these.
    ("SIMPLE_MATH", r"(?=[a-zA-Zα-ωΑ-Ω][=<>+\-*/\s_])(?:\b[a-zA-Zα-ωΑ-Ω]\b\s*=\s*[\w\d]+|(?:\b[a-zA-Zα-ωΑ-Ω]\b|\b[a-zA-Zα-ωΑ-Ω]_\w+)\s*(?:[=<>+\-*/\s]{1,3}\s*(?:\d+|\b[a-zA-Zα-ωΑ-Ω]\b|\b[a-zA-Zα-ωΑ-Ω]_\w+))++)"),
)
_EVERY_SCRIPT = "(?U)"
#: What a text must hold for a kind's pattern to match, as a plain test before the pattern; capitals are tested too.
_NEEDS = {"LITERAL": ("__PROTECTED_",), "LATEX": ("$",), "REF": ("[",), "FIG_TBL": ("рис", "табл", "уравнени", "формул")}


def _interleaved(pieces: Column, between: Column) -> Column:
    """The pieces with the i-th of `between` after the i-th of them."""
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(F.get(between, i), F.lit("")))), "")


def _protected(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    pattern = _EVERY_SCRIPT + pattern
    names = F.transform("_found", lambda _, i: F.concat(F.lit(f"__PROTECTED_{kind}_"), F.size("spans") + i, F.lit("__")))
    new = F.when(F.coalesce(F.size("_found"), F.lit(0)) > 0, _interleaved(F.split("protected", pattern, -1), names)).otherwise(F.col("protected"))
    more = F.transform(F.coalesce("_found", F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("original")))
    able = F.lit(kind not in _NEEDS)
    for needed in _NEEDS.get(kind, ()):
        able = able | F.lower("protected").contains(needed) if kind == "FIG_TBL" else able | F.col("protected").contains(needed)
    found = F.when(able, F.regexp_extract_all("protected", F.lit(pattern), 0))
    # Two steps, so that the pattern looks for matches once.
    return df.withColumn("_found", found).withColumns({"protected": new, "spans": F.concat("spans", more)})


def protected(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds protected (the text with names) and spans (kind and original of each, in order of their numbers)."""
    df = docs.withColumns({"protected": F.col(text), "spans": F.expr("CAST(array() AS array<struct<kind:string,original:string>>)")})
    for kind, pattern in KINDS:
        df = _protected(df, kind, pattern)
    return df.drop("_found")


def _restored(text: Column, spans: Column, kind: str) -> Column:
    start = f"__PROTECTED_{kind}_"
    name = start + r"(\d+)__"

    def original(number: Column) -> Column:
        span = F.get(spans, number.try_cast("int"))
        return F.when(span["kind"] == kind, span["original"]).otherwise(F.concat(F.lit(start), number, F.lit("__")))

    back = _interleaved(F.split(text, name, -1), F.transform(F.regexp_extract_all(text, F.lit(name), 1), original))
    return F.when(text.contains(start), back).otherwise(text)


def restored(text: Column | str, spans: Column | str = "spans") -> Column:
    """A protected text, or a part of one, with what its names stand for, by the spans of the whole text."""
    out = F.col(text) if isinstance(text, str) else text
    spans = F.col(spans) if isinstance(spans, str) else spans
    for kind, _ in reversed(KINDS):
        out = _restored(out, spans, kind)
    return out


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_idx, sentence with names, original (the same sentence as the text has it): no name hides a full stop."""
    rows = protected(docs.select(key, F.col(text).alias("_text")), "_text").withColumn("_list", t.sentence_list(F.col("protected")))
    return rows.select(key, "spans", F.posexplode("_list").alias("sent_idx", "sentence")).select(key, "sent_idx", "sentence", restored("sentence").alias("original"))
