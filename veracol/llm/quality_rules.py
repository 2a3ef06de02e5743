"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

No user functions, no shuffle: each document is measured and judged where it is read.

Defined cases: null or empty text has zero words and fails the base rule; a text of any length is
measured whole; repeated rows are judged one by one; an empty table gives an empty result. Measures
are computed from `text` alone, so extra columns cannot clash with them unless a caller keeps both:
`judged` returns only its own columns, `kept_documents` only the input's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.llm.common import GAP, WORD, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

#: Very common function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the of and to in is a that for was on with as by are it be this from at or an not "
    "la de le les et des en un une du que est pour qui dans par sur pas au avec "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "el los las y del se por con no para su al lo como es"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high; a missing bound does not bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are exact quotients of the counted integers.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=1.5, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)

#: The rules whose failure alone decides, whatever the rest of the table says.
BASE_RULES = ("length", "repeated_windows")


#: Stop words as they are written inside and at the start of a sentence.
_STOP_FORMS = [form for w in STOP_WORDS for form in (w, w.capitalize())]

_BLANKS = " \t\n\x0b\x0c\r"


def _first(text: Column) -> dict[str, Column]:
    inner = F.btrim(text, F.lit(_BLANKS))
    return {
        "_words": F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP)),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
    }


#: Words that lie in a 3-word window found twice or more. Each window becomes one long, its hash above its
#: position, so that sorting (of primitives) puts equal windows side by side in the order of the text; the
#: words themselves confirm a match of hashes; where different windows share a hash, the document's windows are
#: sorted by their words too; each repeated start adds the words the one before doesn't cover.
_BITS = "length(bin(size(_words)))"
_SORTED = (
    "CASE WHEN size(_words) >= 4 THEN sort_array(transform(sequence(0, size(_words) - 3), i -> "
    "(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) & shiftleft(-1L, _bits)) | CAST(i AS BIGINT))) END"
)
_SAME = (
    "(shiftright(x, _bits) = shiftright(get(_windows, {k}), _bits) AND "
    "slice(_words, CAST(x & _low AS INT) + 1, 3) = slice(_words, CAST(get(_windows, {k}) & _low AS INT) + 1, 3))"
)
_CLASH = (
    "exists(sequence(1, size(_windows) - 1), k -> shiftright(get(_windows, k), _bits) = shiftright(get(_windows, k - 1), _bits) AND "
    "slice(_words, CAST(get(_windows, k) & _low AS INT) + 1, 3) <> slice(_words, CAST(get(_windows, k - 1) & _low AS INT) + 1, 3))"
)
_EXACT = (
    f"CASE WHEN size(_words) >= 4 AND {_CLASH} THEN sort_array(transform(_windows, x -> "
    "named_struct('h', shiftright(x, _bits), 'w', slice(_words, CAST(x & _low AS INT) + 1, 3), 'i', x & _low))) END"
)
_STARTS = (
    f"sort_array(CASE WHEN _exact IS NULL THEN transform(filter(_windows, (x, k) -> coalesce({_SAME.format(k='k - 1')}, false) OR coalesce({_SAME.format(k='k + 1')}, false)), x -> x & _low) "
    "ELSE transform(filter(_exact, (x, k) -> coalesce(x.w = get(_exact, k - 1).w, false) OR coalesce(x.w = get(_exact, k + 1).w, false)), x -> x.i) END)"
)
_COVERED = "aggregate(_starts, named_struct('n', 0L, 'last', -3L), (a, i) -> named_struct('n', a.n + least(3L, i - a.last), 'last', i), a -> a.n)"


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the measures of each document's whole text."""
    names = [f"_keep_{i}" for i in range(len(keep))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)]
    df = docs.select(*kept, text_or_empty().alias("_text"))
    df = df.select(*names, *[e.alias(n) for n, e in _first(F.col("_text")).items()])
    df = df.withColumn("_bits", F.expr(_BITS)).withColumn("_low", F.expr("~shiftleft(-1L, _bits)"))
    df = df.withColumn("_windows", F.expr(_SORTED)).withColumn("_exact", F.expr(_EXACT)).withColumn("_starts", F.expr(_STARTS))
    return df.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(_COVERED), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(*_STOP_FORMS))).cast("long").alias("n_stop_words"),
    )


#: Ratios of the table in terms of the counted integers.
METRICS = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1L)",
    "mean_word_chars": "word_chars / greatest(n_words, 1L)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1L)",
    "stop_ratio": "n_stop_words / greatest(n_words, 1L)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1L)",
}


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row fails, as one array expression."""
    fails = []
    for r in rules:
        x = F.expr(METRICS[r.metric])
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (x > F.lit(float(r.high)))
        fails.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*fails))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, the measures, failed_rules, base_failed, kept."""
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return (
        measured(docs, keep)
        .withColumn("failed_rules", compiled(rules))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the input's columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    # The optimiser would move the filter below the measures and repeat them inside one another; it moves
    # none below a column that differs from run to run, such as a row's running number.
    out = judged(whole, rules, keep=("_row",)).select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    out = out.where("kept AND _n >= 0")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL of the judged table, counting windows by a join on their words."""
    ratio = {k: v.replace("CAST(n_words AS DOUBLE)", "n_words").replace("1L", "1").replace(" / ", "::DOUBLE / ") for k, v in METRICS.items()}
    fails = []
    for r in rules:
        bounds = [f"{ratio[r.metric]} < {r.low}" if r.low is not None else "", f"{ratio[r.metric]} > {r.high}" if r.high is not None else ""]
        fails.append(f"CASE WHEN {' OR '.join(b for b in bounds if b)} THEN '{r.name}' END")
    stops = "[" + ", ".join(f"'{w}'" for w in _STOP_FORMS) + "]"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM w),
win AS (SELECT doc_id, i, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS x FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win WHERE x IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains({stops}, x))) AS n_stop_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, array_to_string(list_filter([{', '.join(fails)}], lambda x: x IS NOT NULL), '|') AS failed_rules, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f"""
