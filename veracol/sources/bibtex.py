"""BibTeX as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The head of an entry after its at sign, and a field of its body (values without nested braces).
HEAD = r"(?s)^([a-zA-Z0-9_-]+)\s*\{\s*([a-zA-Z0-9_.:-]+)\s*,\s*(.*)$"
FIELD = r"([a-zA-Z0-9_-]+)\s*=\s*(?:\{([^{}]*)\}|\"([^\"]*)\"|([a-zA-Z0-9_-]+))"


def entries(texts: DataFrame, key: str, text: str, lower_keys: bool = False) -> DataFrame:
    """key, cite_key, type, title, author, year, journal of each entry; a later entry of a key wins.

    Values stand in braces (not nested), quotes, or bare; a missing journal is taken from booktitle.
    lower_keys makes keys match lookups, which are in lower case.
    """
    parts = texts.select(key, F.posexplode(F.split(text, "@")).alias("_n", "_c"))
    cite = F.regexp_extract("_c", HEAD, 2)
    rows = parts.where(F.col("_c").rlike(HEAD)).select(key, "_n", F.lower(F.regexp_extract("_c", HEAD, 1)).alias("type"), (F.lower(cite) if lower_keys else cite).alias("cite_key"), F.regexp_extract("_c", HEAD, 3).alias("_body"))
    groups = [F.regexp_extract_all("_body", F.lit(FIELD), i) for i in range(1, 5)]
    fields = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "kabc", strict=True)]), lambda f: F.struct(F.lower(f["k"]).alias("k"), F.trim(F.concat(f["a"], f["b"], f["c"])).alias("v")))
    rows = rows.withColumn("_f", F.filter(fields, lambda f: f["v"] != ""))

    def field(name: str):
        # The last value of a name counts.
        own = F.filter("_f", lambda f: f["k"] == name)
        return F.coalesce(F.get(F.reverse(own), F.lit(0))["v"], F.lit(""))

    journal = F.when(field("journal") != "", field("journal")).otherwise(field("booktitle"))
    out = rows.select(key, "cite_key", "_n", "type", *[field(n).alias(n) for n in ("title", "author", "year")], journal.alias("journal"))
    last = out.groupBy(key, "cite_key").agg(F.max_by(F.struct("type", "title", "author", "year", "journal"), "_n").alias("_e"))
    return last.select(key, "cite_key", "_e.*")
