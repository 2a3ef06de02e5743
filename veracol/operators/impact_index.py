"""BM25 over an impact index: postings in blocks with their maxima, so that a query reads a part of them.

An index is three stored tables. `chunks` has each chunk's number, key, length and term frequencies. `blocks` has the
postings, sorted by term and cut into blocks: chunk numbers as gaps, each posting's saturation (its term frequency and
length put into BM25's formula, all but the query's part), and the block's maximum. `terms` has a row per term: its
document frequency, maximum and the block that has it.

A search is exact and has two passes. The first reads one block a query term, the one with the term's maximum, and
scores the most promising chunks in it in full: the k-th best of these is a score that the result can't be below.
Terms whose maxima together stay below it can't bring a chunk into the result by themselves. The second pass reads the
blocks of the other terms alone, without those that stay below the threshold even with all other terms at their
maximum, and scores in full only the chunks that can still reach it. Every step is a join or an aggregation; a term
with many postings is many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.operators.retrieval import CONTRIBUTION, K1, B, counted
from veracol.sources.stored import scratch, stored

#: Postings of a block, and chunks of the first pass that are scored in full for each query.
BLOCK, PROMISING = 128, 32
#: Share of the threshold that terms which are not read may bring: the more, the fewer postings are read, and the more
#: chunks must be scored in full.
UNREAD = 0.7
#: Saturations are kept in single precision; bounds are compared with this much to spare.
SLACK = 1e-3
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps (from the first one), in the least width that holds them, which a byte names."""
    gaps = np.diff(numbers)
    most = int(gaps.max()) if len(gaps) else 0
    code = next(i for i, w in enumerate(_WIDTHS) if most <= np.iinfo(w).max)
    return bytes([code]) + gaps.astype(_WIDTHS[code]).tobytes()


def unpacked(first: int, data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, _WIDTHS[data[0]], offset=1).astype(np.int64)
    return first + np.r_[0, np.cumsum(gaps)]


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    blocks: DataFrame
    terms: DataFrame
    #: Of the corpus: chunks, and tokens of all chunks.
    n_chunks: int
    n_tokens: int
    key: str


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that come in order of (term, chunk)."""
    rest = None

    def cut(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
        rows = rows.combine_chunks()
        term = rows.column("term").combine_chunks().dictionary_encode()
        codes = term.indices.to_numpy()
        number, sat = rows.column("number").to_numpy(), rows.column("sat").to_numpy().astype(np.float32)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        ends = np.r_[starts[1:], len(codes)]
        edges = [(s, min(s + BLOCK, e)) for a, e in zip(starts, ends, strict=True) for s in range(a, e, BLOCK)]
        kept = None
        if not last:
            kept = rows.slice(edges[-1][0])
            edges = edges[:-1]
        names = term.dictionary.to_pylist()
        out = pa.RecordBatch.from_arrays([
            pa.array([names[codes[a]] for a, _ in edges], pa.string()), pa.array([int(number[a]) for a, _ in edges], pa.int64()), pa.array([z - a for a, z in edges], pa.int32()),
            pa.array([float(sat[a:z].max()) for a, z in edges], pa.float64()), pa.array([packed(number[a:z]) for a, z in edges], pa.binary()), pa.array([sat[a:z].tobytes() for a, z in edges], pa.binary()),
        ], names=["term", "first", "n", "top", "gaps", "sats"])
        return out, kept

    for batch in batches:
        if len(batch):
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            out, rest = cut(rows, False)
            yield out
    if rest is not None and len(rest):
        yield cut(rest, True)[0]


def built(chunks: DataFrame, key: str) -> Index:
    """An index over chunks (key, chunk_index, chunk), stored in the shared folder."""
    spark = chunks.sparkSession
    folder = scratch(spark, "impact-index")
    held = stored(counted(chunks, key, "chunk_index").withColumn("number", F.monotonically_increasing_id()), f"{folder}/chunks")
    n_chunks, n_tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    mean = max(n_tokens, 1) / max(n_chunks, 1)
    each = held.select("number", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "number", _saturation(F.col("p.tfs"), F.col("dl"), F.lit(mean)).alias("sat"))
    # Ranges of (term, chunk), so that a common term is dealt to many tasks.
    order = each.repartitionByRange("term", "number").sortWithinPartitions("term", "number")
    blocks = stored(order.mapInArrow(_blocks, "term string, first long, n int, top double, gaps binary, sats binary"), f"{folder}/blocks")
    terms = stored(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.max_by("first", "top").alias("best")), f"{folder}/terms")
    return Index(held, blocks, terms, n_chunks, n_tokens, key)


def _saturation(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl / mean)))


def _postings(rows: DataFrame) -> DataFrame:
    """query_id, number and the query's part of the score for each posting of blocks with a weight."""
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            firsts, gaps, sats = (batch.column(c).to_pylist() for c in ("first", "gaps", "sats"))
            numbers = [unpacked(f, g) for f, g in zip(firsts, gaps, strict=True)]
            sizes = np.array([len(x) for x in numbers])
            weight = np.repeat(batch.column("weight").to_numpy(), sizes)
            sat = np.frombuffer(b"".join(sats), np.float32)
            queries = batch.column("query_id").take(pa.array(np.repeat(np.arange(len(batch)), sizes)))
            yield pa.RecordBatch.from_arrays([queries, pa.array(np.concatenate(numbers)), pa.array(weight * sat)], names=["query_id", "number", "part"])

    return rows.select("query_id", "weight", "first", "gaps", "sats").mapInArrow(run, f"query_id {kind}, number long, part double")


@dataclass(frozen=True)
class Search:
    """The parts of a search; `best` is its result, `read` what it read."""

    index: Index
    terms: DataFrame
    first: DataFrame
    second: DataFrame
    best: DataFrame


def search(queries: DataFrame, index: Index, k: int = 3) -> Search:
    """The k best chunks of each query (query_id, query), by score, then order in the corpus; scores over 0 only."""
    folder = scratch(queries.sparkSession, "impact-search")
    asked = queries.select("query_id", F.explode(t.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    n = F.lit(index.n_chunks).cast("long")
    idf = F.log(F.greatest((n - F.col("df") + 0.5) / (F.col("df") + 0.5), F.lit(1e-5)) + 1)
    terms = stored(asked.join(index.terms, "term").withColumn("idf", idf).withColumn("weight", F.col("qf") * F.col("idf")).withColumn("bound", F.col("weight") * F.col("top")), f"{folder}/terms")

    # First pass: each term's best block, a threshold from the chunks that do best there.
    best_blocks = terms.drop("top").join(index.blocks.select("term", "first", "n", "gaps", "sats"), ["term"]).where("first = best")
    sums = _postings(best_blocks).groupBy("query_id", "number").agg(F.sum("part").alias("part"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "number"))
    promising = sums.withColumn("_r", top).where(F.col("_r") <= PROMISING).select("query_id", "number")
    scored = _scored(promising, terms, index).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_score"), "number")))
    threshold = scored.where(F.col("_r") == k).select("query_id", F.col("_score").cast("double").alias("least"))

    # Second pass: terms that stay below the threshold together need no reading; those with the most postings for their
    # bound are left out first.
    bounded = terms.join(threshold, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    rising = Window.partitionBy("query_id").orderBy(F.col("bound") / F.col("df"), "term")
    below = F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("bound").over(Window.partitionBy("query_id"))
    bounded = bounded.withColumn("below", below).withColumn("whole", whole).withColumn("needed", F.col("below") >= F.col("least") * UNREAD - SLACK)
    bounded = bounded.withColumn("left_out", F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("query_id")))
    bounded = stored(bounded.select("query_id", "term", "weight", "bound", "least", "whole", "left_out", "needed"), f"{folder}/bounds")
    blocks = bounded.where("needed").join(index.blocks, "term").where(F.col("whole") - F.col("bound") + F.col("weight") * F.col("top") >= F.col("least") - SLACK)
    sums = _postings(blocks).groupBy("query_id", "number").agg(F.sum("part").alias("part"))
    limits = bounded.groupBy("query_id").agg(F.first("least").alias("least"), F.first("left_out").alias("left_out"))
    able = sums.join(limits, "query_id").where(F.col("part") + F.col("left_out") >= F.col("least") - SLACK).select("query_id", "number")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_score"), index.key, "chunk_index"))
    best = _scored(able, terms, index).withColumn("rank", rank).where(F.col("rank") <= k)
    return Search(index, terms, best_blocks, blocks, best.select("query_id", "rank", index.key, "chunk_index", F.col("_score").cast("double").alias("score")))


def _scored(pairs: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """The full score of each pair of a query and a chunk, from the chunk's own terms; scores over 0 only."""
    mean = F.greatest(F.lit(index.n_tokens).cast("long"), F.lit(1)) / F.lit(max(index.n_chunks, 1)).cast("long")
    rows = pairs.join(index.chunks, "number").select("query_id", "number", index.key, "chunk_index", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_p"))
    rows = rows.select("query_id", "number", index.key, "chunk_index", "dl", F.col("_p.terms").alias("term"), F.col("_p.tfs").cast("long").alias("tf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("dl") / mean)))
    hits = rows.join(terms.select("query_id", "term", "qf", "idf"), ["query_id", "term"]).withColumn("_part", part.cast(CONTRIBUTION))
    return hits.groupBy("query_id", "number", index.key, "chunk_index").agg(F.sum("_part").cast("decimal(28,6)").alias("_score")).where("_score > 0")


def read(found: Search) -> DataFrame:
    """query_id, postings of all its terms, and those in the blocks that each pass read."""
    count = lambda df, name: df.groupBy("query_id").agg(F.sum("n").alias(name))
    out = found.terms.groupBy("query_id").agg(F.sum("df").alias("all_postings"))
    for df, name in ((found.first, "first_pass"), (found.second, "second_pass")):
        out = out.join(count(df, name), "query_id", "left")
    return out.na.fill(0, ["first_pass", "second_pass"])
