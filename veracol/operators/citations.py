"""Citations in a text, its bibliography, and the reconciliation of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.functions.lexicons import BIBLIOGRAPHY_HEADERS
from veracol.functions.text import LONGEST_RANGE, header_place

# The grammar of brackets, ranges and list entries.
LETTER = "[a-zA-Zа-яА-ЯёЁ]"
RANGE = r"^(\d+)\s*[-–—]\s*(\d+)$"
BRACKET = r"\[\s*(\d+[\s,;\-–—\d]*)\s*\]"
LISTED = r"(?:^|\n)\s*(?:\[(\d+)\]|(\d+)\.\s+)"
#: Citation numbers: up to 38 digits; longer runs of digits are none.
NUMBER = "decimal(38,0)"
#: Numbers of a range that one row expands to at once.
SLICE = 10_000


def _lit(pattern: str) -> str:
    return "r'" + pattern + "'"


def _ends(p: str, other: str) -> str:
    """SQL for the ends (a, b) of a part of a bracket, as an array of none or one."""
    a, b = (f"try_cast(regexp_extract({p}, {_lit(RANGE)}, {i}) AS {NUMBER})" for i in (1, 2))
    return f"CASE WHEN {p} RLIKE {_lit(RANGE)} THEN filter(array(named_struct('a', {a}, 'b', {b})), x -> x.a <= x.b) ELSE {other} END"


def _brackets(sentence: str, each_named: str, each_numbered: str) -> Column:
    """An array of what the column's brackets give: expressions of k (a bracket's content) and of p (a part of it)."""
    parts = "transform(split(k, '[,;]'), p -> regexp_replace(p, r'^\\s+|\\s+$', ''))"
    return F.expr(
        f"flatten(transform(transform(regexp_extract_all({sentence}, '\\\\[([^\\\\]]+)\\\\]', 1), k -> trim(k)), "
        f"k -> CASE WHEN k RLIKE '{LETTER}' THEN {each_named} ELSE flatten(transform({parts}, p -> {each_numbered})) END))"
    )


_NAMES = "filter(transform(split(k, ';'), p -> lower(regexp_replace(p, '[^a-zA-Zа-яА-ЯёЁ0-9]', ''))), p -> p <> '')"
_DIGITS = "CASE WHEN regexp_replace(p, r'\\D', '') = '' THEN array() ELSE array(regexp_replace(p, r'\\D', '')) END"


def keys(sentence: str) -> Column:
    """Citation keys of a column's brackets as text, in order, with repeats.

    For display: a range of more than LONGEST_RANGE numbers is named by its two ends. `key_ranges` has all of it.
    """
    ends = f"CASE WHEN x.b - x.a > {LONGEST_RANGE} THEN array(x.a, x.b) ELSE transform(sequence(0, CAST(x.b - x.a AS INT)), i -> CAST(x.a + i AS {NUMBER})) END"
    numbered = f"CASE WHEN p RLIKE {_lit(RANGE)} THEN flatten(transform({_ends('p', 'array()')}, x -> transform({ends}, n -> CAST(n AS STRING)))) ELSE {_DIGITS} END"
    return _brackets(sentence, _NAMES, numbered)


def key_ranges(sentence: str) -> Column:
    """What a column's brackets cite, in order: names as key, numbers and ranges (of any length) as low and high."""
    named = f"transform({_NAMES}, n -> named_struct('key', n, 'low', CAST(NULL AS {NUMBER}), 'high', CAST(NULL AS {NUMBER})))"
    pair = "named_struct('key', CAST(NULL AS STRING), 'low', x.a, 'high', x.b)"
    single = f"filter(transform({_DIGITS}, d -> named_struct('a', try_cast(d AS {NUMBER}), 'b', try_cast(d AS {NUMBER}))), x -> x.a IS NOT NULL)"
    return _brackets(sentence, named, f"transform({_ends('p', single)}, x -> {pair})")


def _cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    at = header_place(F.col(text), BIBLIOGRAPHY_HEADERS)
    df = docs.select(key, F.col(text).alias("_t"), at.alias("_at"))
    body = F.expr("CASE WHEN _at < 0 THEN _t ELSE substring(_t, 1, _at) END")
    return df.select(key, body.alias("_body"), F.expr("CASE WHEN _at >= 0 THEN substring(_t, _at + 1) END").alias("_tail"))


def _parts(body: Column) -> Column:
    """The parts of a text's citation brackets, each a number, or two with a dash, or nothing that counts."""
    held = F.array_join(F.regexp_extract_all(body, F.lit(BRACKET), F.lit(1)), ";")
    return F.split(F.translate(held, ",–—", ";--"), ";")


def _low_high(part: str) -> tuple[Column, Column]:
    """The ends of a part; null for what is neither a number nor a range."""
    alone = f"substring_index({part}, '-', 2) = {part}"
    low, high = (F.expr(f"CASE WHEN {alone} THEN try_cast(substring_index({part}, '-', {i}) AS {NUMBER}) END") for i in (1, -1))
    return low, high


def cited_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, low, high: the intervals of numbers cited before the bibliography, merged, so that none touches another."""
    # Outer, as Spark would else ask for the array's size first and read the text twice for it.
    parts = _cut(docs, key, text).select(key, F.explode_outer(_parts(F.col("_body"))).alias("_p"))
    low, high = _low_high("_p")
    return merged(parts.select(key, low.alias("low"), high.alias("high")).where("low <= high"), key)


def merged(ranges: DataFrame, key: str) -> DataFrame:
    """Intervals of each key joined where they overlap or follow one another: one sort, one pass."""
    seen = Window.partitionBy(key).orderBy("low", "high")
    before = F.max("high").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (F.col("low") > before + 1)
    rows = ranges.distinct().withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def expanded(ranges: DataFrame) -> DataFrame:
    """One row a number, as column `number` in place of low and high: for the sink, since it is as long as the ranges.

    Rows come slice by slice, so that no row holds more than SLICE numbers.
    """
    others = [c for c in ranges.columns if c not in ("low", "high")]
    last = f"CAST(floor((high - low) / {SLICE}) AS BIGINT)"
    # Slices of slices, as a sequence is limited as well.
    outer = ranges.selectExpr(*others, "low", "high", f"explode(sequence(0L, CAST(floor({last} / {SLICE}) AS BIGINT))) AS _o")
    inner = outer.selectExpr(*others, "low", "high", "_o", f"explode(sequence(_o * {SLICE}, least(_o * {SLICE} + {SLICE - 1}, {last}))) AS _s")
    first = inner.selectExpr(*others, "high", f"CAST(low + CAST(_s AS {NUMBER}) * {SLICE} AS {NUMBER}) AS _first")
    return first.selectExpr(*others, "_first", f"explode(sequence(0, CAST(least({SLICE - 1}, high - _first) AS INT))) AS _i").selectExpr(*others, f"CAST(_first + _i AS {NUMBER}) AS number")


def cited_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number: the numbers cited before the bibliography, one by one."""
    return expanded(cited_ranges(docs, key, text))


def listed_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number: the numbers that the bibliography lists."""
    found = F.concat(*[F.regexp_extract_all("_tail", F.lit(LISTED), i) for i in (1, 2)])
    rows = _cut(docs, key, text).where("_tail IS NOT NULL").select(key, F.explode(F.filter(found, lambda x: x != "")).alias("n"))
    return rows.select(key, F.expr(f"try_cast(n AS {NUMBER})").alias("number")).where("number IS NOT NULL").distinct()


def bibliography(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entry_key, entry: lines that don't open an entry belong to the one before; a later entry of a key wins."""
    start = r"^\s*(?:\[([a-zA-Z0-9_.-]+)\]|([0-9]+)\.\s+)"
    lines = _cut(docs, key, text).where("_tail IS NOT NULL").select(key, F.posexplode(F.split("_tail", "\n")).alias("_n", "_line"))
    lines = lines.withColumn("_s", F.trim("_line")).where("_s <> ''")
    header = None
    for h in BIBLIOGRAPHY_HEADERS:
        header = F.lower("_s").contains(h) if header is None else header | F.lower("_s").contains(h)
    lines = lines.where(~(header & (F.length("_s") < 30)))
    opens = F.col("_line").rlike(start)
    own = F.coalesce(F.nullif(F.regexp_extract("_line", start, 1), F.lit("")), F.nullif(F.regexp_extract("_line", start, 2), F.lit("")))
    lines = lines.select(key, "_n", opens.alias("_opens"), F.lower(own).alias("_key"), F.when(opens, F.trim(F.regexp_replace("_line", start, ""))).otherwise(F.col("_s")).alias("_part"))
    entry = F.sum(F.col("_opens").cast("int")).over(Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_e", entry).where("_e > 0")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), " ")
    entries = lines.groupBy(key, "_e").agg(F.max("_key").alias("entry_key"), F.trim(parts).alias("entry"))
    return entries.groupBy(key, "entry_key").agg(F.max_by("entry", "_e").alias("entry"))


def integrity_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Warnings of documents that have a bibliography, as intervals: numbers cited but not listed, and listed but not cited.

    `index` is that of an interval's first number: warnings count down from -1 by type and number. Each text is read once;
    its ranges and listed numbers are swept in one order, so that a range costs one row, however many numbers it spans.
    """
    listed = F.regexp_extract_all("_tail", F.lit(LISTED), F.lit(0)).alias("_listed")
    texts = _cut(docs, key, text).select(key, listed, _parts(F.expr("CASE WHEN _tail IS NOT NULL THEN _body END")).alias("_parts"))
    # Asked within the array: a condition on the texts would be moved to where they come from, and read them once more.
    texts = texts.select(key, F.size("_listed").alias("_n"), F.when(F.size("_listed") > 0, F.concat("_listed", "_parts")).alias("_all"))
    rows = texts.select(key, "_n", F.posexplode_outer("_all").alias("_i", "_p")).where("_i IS NOT NULL")
    low, high = _low_high("_p")
    kind, number = F.expr("CAST(_i < _n AS INT)"), F.regexp_extract("_p", r"\d+", 0).try_cast(NUMBER)
    rows = rows.select(key, kind.alias("_kind"), F.when(F.expr("_i < _n"), number).otherwise(low).alias("_at"), F.when(F.expr("_i >= _n"), high).alias("_high"))
    rows = rows.where("_at IS NOT NULL AND (_kind = 1 OR _at <= _high)")
    # All windows have one order, so that rows are sorted once. At a number, ranges come before what is listed.
    sweep = Window.partitionBy(key).orderBy("_at", "_kind")
    whole = sweep.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sweep.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_reach": F.max("_high").over(before), "_last": F.max("_high").over(whole), "_lists": F.max("_kind").over(whole)}).where("_lists = 1")
    # A range that touches those before it opens nothing; they reach as far as the next row is told, or to the last end.
    rows = rows.where("_kind = 1 OR NOT coalesce(_reach >= _at - 1, FALSE)")
    rows = rows.withColumns({"_next": F.lead("_at").over(sweep), "_to": F.coalesce(F.lead("_reach").over(sweep), F.when(F.lead("_at").over(sweep).isNull(), F.col("_last")))})
    # Up to the next row, what ranges reach is missing, but for the row's own number if that is listed.
    rows = rows.withColumns({"_after": F.expr(f"CAST(CASE WHEN _kind = 0 THEN _at - 1 ELSE _at END AS {NUMBER})"), "_to": F.expr(f"CAST(CASE WHEN _next <= _to THEN _next - 1 ELSE _to END AS {NUMBER})")})
    unused = "_kind = 1 AND NOT coalesce(_next = _at, FALSE) AND NOT coalesce(_reach >= _at, FALSE)"
    rows = rows.withColumn("_missing", F.expr(f"CASE WHEN _after < _to THEN TRUE WHEN {unused} THEN FALSE END")).where("_missing IS NOT NULL")
    size = F.expr("CASE WHEN _missing THEN _to - _after END")
    rows = rows.withColumns({"_before": F.sum(size).over(before), "_all": F.sum(size).over(whole), "_unused": F.count_if(~F.col("_missing")).over(before)})
    low, high = F.expr(f"CAST(CASE WHEN _missing THEN _after + 1 ELSE _at END AS {NUMBER})"), F.expr("CASE WHEN _missing THEN _to ELSE _at END")
    kind = F.when(F.col("_missing"), "citation_missing_bibliography").otherwise("citation_unused_bibliography")
    index = F.expr(f"CAST(-1 - CASE WHEN _missing THEN coalesce(_before, 0) ELSE coalesce(_all, 0) + _unused END AS {NUMBER})")
    return rows.select(key, low.alias("low"), high.alias("high"), kind.alias("issue_type"), F.when(F.col("_missing"), "high").otherwise("low").alias("severity"), index.alias("index"))


def integrity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same warnings, a row for each number."""
    rows = integrity_ranges(docs, key, text).withColumnRenamed("index", "_top").withColumn("_low", F.col("low"))
    return expanded(rows).withColumn("index", F.expr(f"CAST(_top - (number - _low) AS {NUMBER})")).select(key, "number", "issue_type", "severity", "index")


def resolved(requests: DataFrame, local: DataFrame, cache: DataFrame, bibtex: DataFrame, entries: DataFrame) -> DataFrame:
    """Where each requested key finds evidence: local texts, then the cache (a null title is a known failure).

    `lookup` is what an external search would be asked for keys that neither has; each key is looked up once,
    however many requests share it.
    """
    want = requests.withColumn("_key", F.lower("key"))
    keys_ = want.select("_key").distinct()
    side = lambda df, name: df.select(F.lower("key").alias("_key"), F.struct(*[c for c in df.columns if c != "key"]).alias(name))
    found = keys_
    for df, name in ((local.select("key").distinct().withColumn("has", F.lit(True)), "_l"), (cache, "_c"), (bibtex, "_b"), (entries, "_e")):
        found = found.join(side(df, name), "_key", "left")
    asked = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "_b.title", "_b.author", "_b.year")), F.lit("")), F.col("_e.entry"))
    source = F.when(F.col("_l.has"), "local").when(F.col("_c.title").isNotNull(), "online").otherwise("unknown")
    title = F.when(F.col("_l.has"), F.col("_b.title")).otherwise(F.col("_c.title"))
    found = found.select("_key", source.alias("source"), title.alias("_title"), F.when(F.col("_l.has"), F.struct("_b.author", "_b.year")).alias("_meta"), F.when(F.col("_l").isNull() & F.col("_c").isNull(), asked).alias("lookup"))
    out = want.join(found, "_key")
    return out.select(*requests.columns, "source", F.coalesce("_title", F.concat(F.lit("reference "), "key")).alias("title"), F.coalesce("_meta.author", F.lit("")).alias("author"), F.coalesce("_meta.year", F.lit("")).alias("year"), "lookup")
