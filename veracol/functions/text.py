"""Text functions as column expressions: no user functions, so Catalyst sees through them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"
#: Neither letter, digit nor underscore: a word boundary that means the same for every script and engine.
EDGE = r"[^\p{L}\p{N}_]"
# Ordered protections, name and pattern of the spans that style rules must not see.
PROTECTED = (
    ("LATEX", r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$"),
    ("REF", r"\[\s*\d+[\s,;\-–—\d]*\s*\]"),
)
#: Longest citation range that citation keys (and the SQL counterparts) expand within a row; longer ones count as their two ends.
LONGEST_RANGE = 1_000_000


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def word_list(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def protect(c: Column) -> Column:
    """The text with each protected span replaced by its kind's placeholder."""
    for name, pattern in PROTECTED:
        c = F.regexp_replace(c, pattern, f"__PROTECTED_{name}__")
    return c


def sentence_list(c: Column) -> Column:
    """Sentences of a text: split at a full stop and a space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\. "), trimmed), lambda s: s != "")


def _quoted(phrase: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]|()\\" else ch for ch in phrase).replace(" ", r"\s+")


def phrase_pattern(phrase: str) -> str:
    """A pattern that finds the phrase between word boundaries, white space matching any."""
    return f"(?:^|{EDGE}){_quoted(phrase)}(?:$|{EDGE})"


def _has_phrase(c: Column, phrase: str) -> Column:
    """Whether `phrase_pattern` matches: its words as plain text first, then the phrase without its boundaries, which few texts
    pass, as looking for boundaries everywhere costs most."""
    found = c.rlike(phrase_pattern(phrase))
    if phrase.strip() != phrase or not phrase:
        return found
    found = c.rlike(_quoted(phrase)) & found
    for word in reversed(phrase.split(" ")):
        found = c.contains(word) & found
    return found


def phrases_in(c: Column, phrases: Iterable[str]) -> Column:
    """The phrases that the (lower-cased) text has, each once, in the order given."""
    return F.array_compact(F.array(*[F.when(_has_phrase(c, p), F.lit(p)) for p in phrases]))


def first_contained(c: Column, classes: Iterable[tuple[str, Iterable[str]]], default: str) -> Column:
    """The first class any of whose words is a substring of the (lower-cased) text."""
    out = None
    for name, words in classes:
        hit = None
        for w in words:
            hit = c.contains(w) if hit is None else hit | c.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def tokens(c: Column) -> Column:
    """Lower-case runs of Latin and Cyrillic letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9а-яё]+)"), 1)


def chunks(text: str, size: int = 500, overlap: int = 100) -> Column:
    """Windows of a column's white-space collapsed text; one if it fits.

    The text is cut once into pieces that windows are made of, as a substring is sought from the text's start each time.
    """
    unit = math.gcd(size, size - overlap)
    step, most = (size - overlap) // unit, size // unit
    clean = f"trim(regexp_replace({text}, r'[\\s\\p{{Z}}]+', ' '))"
    return F.expr(
        f"transform(array(regexp_extract_all({clean}, '(?s).{{1,{unit}}}', 0)), p -> CASE WHEN p IS NULL OR size(p) = 0 THEN array() WHEN size(p) <= {most} THEN array(array_join(p, '')) ELSE "
        f"transform(sequence(0, size(p) - 1, {step}), i -> trim(array_join(slice(p, i + 1, {most}), ''))) END)[0]"
    )


def letters(c: Column) -> Column:
    """The text's letters, digits and underscores, lower case."""
    return F.regexp_replace(F.lower(c), EDGE, "")


def grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text's letters, digits and underscores, lower case."""
    clean = letters(c)
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(f"(?=({'.' * n}))"), 1))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def light_stem(c: Column, suffixes: Iterable[str]) -> Column:
    """The word without its longest listed suffix that leaves three letters or more."""
    longest = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return F.when(F.length(c) <= 3, c).otherwise(F.regexp_replace(c, f"(?<=^.{{3,200}})(?:{longest})$", ""))


def header_place(c: Column, headers: Iterable[str]) -> Column:
    """Place (from 0) of the last occurrence of the first listed header that the text has; -1 without one."""
    # Bound as a variable, as the lower-cased text would else be made for each header.
    place = lambda low: F.coalesce(*[F.when(low.contains(h), F.length(low) - F.length(F.substring_index(low, h, -1)) - len(h)) for h in headers], F.lit(-1))
    return F.transform(F.array(F.lower(c)), place)[0]


def title_words(c: Column, stop_words: Iterable[str]) -> Column:
    """Distinct words of three characters or more that can tell a title."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-zа-яё0-9]{3,})"), 1)
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]))


def filename_key(c: Column) -> Column:
    """Citation key of a file name: its stem, trimmed, lower case, without brackets."""
    stem = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.lower(F.trim(F.regexp_replace(stem, r"[\[\]]", "")))
