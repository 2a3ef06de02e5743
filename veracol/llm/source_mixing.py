"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget by weight, none above a multiple of its own size. A source's complete epochs come
first; the rest of its budget is filled in the order of exponential keys -ln(u) / quality, whose prefix sums
of words meet the budget. u is a hash of the doc_id and a seed, so reruns agree.

The prefix sums need no sort of a source in one task: keys fall into fixed buckets, bucket totals give each
source's cut bucket, and only the rows of that bucket are sorted.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own, last
in order; the document at the cut takes the words that remain; ties of keys go by doc_id, then size, and
equal rows are interchangeable; an empty table gives an empty result; only doc_id, text and source are
read, so extra columns cannot clash.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.llm.common import GAP, text_or_empty, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has 3/2 of all words; a source gives at most twice its own.
BUDGET = (3, 2)
MOST_EPOCHS = 2
#: Buckets of a source's keys.
BUCKETS = 4096
SEED = 1
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def keyed(docs: DataFrame, seed: int = SEED, buckets: int = BUCKETS, whole: bool = False) -> DataFrame:
    """doc_id, source, size, key and bucket of every row; with `whole`, `row` too, which holds the input's columns.

    A document's quality weight falls with its symbols a word; a smaller key is taken earlier.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    quality = F.lit(1.0) / (1 + symbols / F.greatest("size", F.lit(1)))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(uniform) / quality
    names = ["row"] if whole else []
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"), *row)
        .withColumn("size", words(F.col("text")))
        .select("doc_id", "source", "size", key.alias("key"), *names)
        .withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, epochs, budget of each row of (source, source_size), in integers to the end.

    Sources in the order of size over weight: one is capped exactly if, with all before it capped, its share
    of what is left exceeds its cap.
    """
    top, below = BUDGET
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    multiple = lcm(*weights)
    df = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    df = df.withColumn("ratio", F.expr(f"source_size * ({multiple} div w)")).withColumn("cap", F.lit(MOST_EPOCHS) * F.col("source_size"))
    df = df.withColumn("total", F.lit(top) * F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("capped", (F.col("total") - below * before) * F.col("w") > below * F.col("cap") * after)
    df = df.withColumn("left", F.col("total") - below * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
    df = df.withColumn("open", below * F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(every), F.lit(1)))
    share = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / F.col("open"))
    words_due = F.expr("CASE WHEN capped THEN cap ELSE (w * left) div open END")
    df = df.withColumn("target", share).withColumn("due", words_due)
    df = df.withColumn("epochs", F.expr("CASE WHEN source_size = 0 THEN 0L ELSE due div source_size END"))
    return df.select("source", "source_size", "target", "epochs", (F.col("due") - F.col("epochs") * F.col("source_size")).alias("budget"))


def planned(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_source, source_size, target, epochs, budget, cut (bucket) and ahead (words in the buckets before it) of
    each source. sums: source, bucket, words."""
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .join(plan.select(F.col("source").alias("_s"), F.col("budget").alias("_b")), F.col("source").eqNullSafe(F.col("_s")))
        .where("ahead <= _b")
        .groupBy("source")
        .agg(F.max_by(F.struct("bucket", "ahead"), "bucket").alias("cut"))
        .select(F.col("source").alias("_s"), "cut")
    )
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "budget", F.col("cut.bucket").alias("cut"), F.col("cut.ahead").alias("ahead"))
    return written(plan, "source_plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Keyed rows with their source's plan, `taken` and `copies`; only those of a cut bucket are sorted."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    whole = joined.where("NOT bucket <=> cut").withColumn("part", F.expr("CASE WHEN bucket < cut THEN size ELSE 0L END"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = joined.where("bucket <=> cut").withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at_cut = at_cut.withColumn("part", F.expr("least(size, greatest(0L, budget - before))")).drop("before")
    every = whole.unionByName(at_cut).withColumn("taken", F.expr("epochs * size + part"))
    return every.withColumn("copies", F.expr("epochs + CAST(size > 0 AND 2 * part >= size AS BIGINT)"))


def _sums(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket_words")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row.

    `taken` counts words with repeats; `copies` counts whole documents, the one at the cut if at least half
    of it is taken.
    """
    rows = written(keyed(docs, seed, buckets), "keyed")
    return taken(rows, planned(_sums(rows), weights)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: each row as often as it is taken whole, with the input's columns.

    Rows are keyed again as they are read, so that whole documents are not shuffled but for a cut bucket's.
    """
    plan = planned(_sums(keyed(docs, seed, buckets)), weights)
    rows = taken(keyed(docs, seed, buckets, whole=True), plan).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / (1.0 / (1 + symbols / greatest(size, 1))) AS key
  FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS BIGINT) AS w, 2 * source_size AS cap,
    3 * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sums),
ordered AS (
  SELECT *, (total - 2 * coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    > 2 * cap * sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM weighed WINDOW r AS (ORDER BY source_size * (6 // w), source IS NULL, source)),
level AS (
  SELECT *, CAST(total - 2 * coalesce(sum(cap) FILTER (capped) OVER (), 0) AS BIGINT) AS rest,
    CAST(2 * coalesce(sum(w) FILTER (NOT capped) OVER (), 1) AS BIGINT) AS open FROM ordered),
plan AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / open END AS target,
    CASE WHEN capped THEN cap ELSE (w * rest) // open END AS due FROM level),
placed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target,
    CASE WHEN p.source_size = 0 THEN 0 ELSE p.due // p.source_size END AS epochs, p.due,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, least(size, greatest(0, due - epochs * source_size - before)) AS part FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN size > 0 AND 2 * part >= size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM parts
"""
