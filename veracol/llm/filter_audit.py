"""How filters interact: what each removes in every order, alone, in vain, and on average.

Each document gets a mask of the filters that it fails. Four conditions are column expressions. Duplicates come of a
sort: rows are dealt by ranges of (text fingerprint, doc_id), sorted in their part by fingerprint, whole text and
doc_id, and each is compared with the one before it. What lies across a part's boundary can only be of the part's
first or last fingerprint; the rows there that have no predecessor are kept with the digest of their text and matched
among themselves. A hot text is cut into ranges of ids as any other rows are. Masks are then counted by part of the
corpus, and every figure of the audit is a sum of those counters, so that parts and later additions add up.

Defined cases: null text is empty; null lang is the part of the empty string; rows of one id and text are no
duplicates of each other (no smaller id has the text); a row without an id neither is a duplicate nor makes one;
labels without an id count for nothing, repeated ones once; an empty table gives no parts; only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracol.llm.common import GAP, WORD, text_or_empty, written

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bounds of the conditions A, B and C (words; distinct words and capitals in per cent), and the symbols of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_MASKED = "doc_id long, part string, mask int, edge_print long, edge_text binary"


def conditions(text: Column) -> Column:
    """The mask of the conditions that look at one text alone."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(SYMBOLS)]
    mask = F.lit(0)
    for i, f in enumerate(failed):
        mask = mask + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (print, text, doc_id) with duplicates marked; those that a neighbouring part may decide are edges."""
    first = last = last_text = None
    head = np.iinfo(np.int64).max  # the smallest id of the run at hand
    held: list[pa.RecordBatch] = []  # rows of the last fingerprint that is not the first

    def rows(batch: pa.RecordBatch, mask: np.ndarray, take: np.ndarray, edge: bool) -> pa.RecordBatch:
        at = pa.array(np.flatnonzero(take))
        n, texts = len(at), batch.column("text")
        prints = batch.column("print").take(at) if edge else pa.nulls(n, pa.int64())
        digests, seen = [], (None, None)
        for i in at.to_pylist() if edge else ():
            if run[i] != seen[0]:
                seen = (run[i], sha256(texts[i].as_py().encode()).digest())
            digests.append(seen[1])
        edges = pa.array(digests, pa.binary()) if edge else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("part").take(at), pa.array(mask[take], pa.int32()), prints, edges], names=["doc_id", "part", "mask", "edge_print", "edge_text"])

    def settled(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kept:
            yield b.set_column(3, "edge_print", pa.nulls(len(b), pa.int64())).set_column(4, "edge_text", pa.nulls(len(b), pa.binary()))

    for batch in batches:
        n = len(batch)
        if n == 0:
            continue
        prints, texts, ids = batch.column("print").to_numpy(), batch.column("text"), batch.column("doc_id")
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy()
        same = np.zeros(n, bool)
        same[0] = last is not None and prints[0] == last and texts[0].as_py() == last_text
        if n > 1:
            same[1:] = (prints[1:] == prints[:-1]) & pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        run, starts = np.cumsum(~same), np.flatnonzero(~same)
        if same[0]:
            starts = np.r_[0, starts]
        heads = np.minimum.reduceat(number, starts)
        heads[0] = min(heads[0], head) if same[0] else heads[0]
        late = known & (number > np.repeat(heads, np.diff(np.r_[starts, n])))
        mask = batch.column("mask").to_numpy() + np.where(late, DUPLICATE, 0)
        first = prints[0] if first is None else first
        if last is not None and prints[-1] != last:
            yield from settled(held)
            held = []
        last, last_text, head = prints[-1], texts[n - 1].as_py(), heads[-1]
        open_ = known & ~late
        in_first, in_last = open_ & (prints == first), open_ & (prints == last) & (prints != first)
        yield rows(batch, mask, ~(in_first | in_last), False)
        yield rows(batch, mask, in_first, True)
        if in_last.any():
            held.append(rows(batch, mask, in_last, True))
    yield from held


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every document; bit i is set if it fails filter i."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    ranged = rows.withColumn("print", F.xxhash64("text")).repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    found = written(ranged.withColumn("mask", conditions(F.col("text"))).mapInArrow(_compared, _MASKED), "audit_masks")
    edges = found.where("edge_text IS NOT NULL")
    heads = edges.groupBy(F.col("edge_print").alias("p"), F.col("edge_text").alias("t")).agg(F.min("doc_id").alias("head"))
    late = edges.join(heads, (F.col("edge_print") == F.col("p")) & (F.col("edge_text") == F.col("t")))
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("head"), F.lit(DUPLICATE)).otherwise(F.lit(0))
    return found.where("edge_text IS NULL").select("doc_id", "part", "mask").unionByName(late.select("doc_id", "part", mask.alias("mask")))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents, good ones and toxic ones have it: sums, so counters of parts add up."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = masks.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "good", "toxic")
    rows = known.unionByName(masks.where("doc_id IS NULL").selectExpr("part", "mask", "CAST(NULL AS INT) AS good", "CAST(NULL AS INT) AS toxic"))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counters alone."""
    mask, n = F.col("mask"), F.col("n")
    sets, orders = range(1 << len(filters)), [*permutations(range(len(filters)))]

    def passing(column: str) -> Column:
        """How many fail none of a set of filters, by the set's mask."""
        return F.array(*[F.sum(F.when(mask.bitwiseAND(s) == 0, F.col(column)).otherwise(F.lit(0))) for s in sets])

    unique = F.array(*[F.sum(F.when(mask == 1 << i, n).otherwise(F.lit(0))) for i in range(len(filters))])
    # Among a document's failing filters each comes first in an equal share of the orders.
    first = F.lit(len(orders)) * n / F.bit_count(mask)
    shapley = F.array(*[F.sum(F.when(mask.bitwiseAND(1 << i) != 0, first.cast("long")).otherwise(F.lit(0))) for i in range(len(filters))])
    parts = counts.groupBy("part").agg(passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"), unique.alias("unique_fails"), shapley.alias("shapley"))

    steps = [(order, step) for order in orders for step in range(len(filters))]
    plan = F.array(*[F.struct(
        F.lit("".join(filters[i] for i in order)).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(order[step]).alias("i"),
        F.lit(sum(1 << i for i in order[:step])).alias("before"), F.lit(sum(1 << i for i in order[: step + 1])).alias("after"),
    ) for order, step in steps])
    rows = parts.withColumn("s", F.explode(plan))
    at = lambda column, place: F.get(F.col(column), place)
    lost = lambda column: at(column, F.col("s.before")) - at(column, F.col("s.after"))
    fails = at("n", F.lit(0)) - at("n", F.expr("shiftleft(1, s.i)"))
    return rows.select(
        "part", "s.filter_order", "s.step", at("n", F.col("s.after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        at("unique_fails", F.col("s.i")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", F.col("s.i")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over `documents`."""
    return audit(counters(masked(docs), labels))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d),
f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '{SYMBOLS}') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT f.*, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM f LEFT JOIN l USING (doc_id)),
failed AS (SELECT part, good, toxic, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS fails FROM m),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
named AS (SELECT *, substr(filter_order, step, 1) AS letter, string_split(left(filter_order, step - 1), '') AS earlier FROM steps),
groups AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
each AS (
  SELECT part, filter_order, step, letter, n, good, toxic, list_contains(fails, letter) AS hit, len(fails) AS k, step > 1 AND list_has_any(fails, earlier) AS gone FROM groups CROSS JOIN named),
sums AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (hit AND k = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums
"""
