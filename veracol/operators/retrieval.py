"""BM25 over chunks: postings as a table, queries joined to them on terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.sources.stored import scratch, stored

K1, B = 1.5, 0.75
#: A term's contribution is kept in so many decimals, so that sums do not depend on their order.
CONTRIBUTION = "decimal(20,9)"


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, chunk of every text."""
    return docs.select(key, F.posexplode(t.chunks(text)).alias("chunk_index", "chunk"))


#: The terms of lower-cased text, as `text.tokens` finds them.
TERM = re.compile("[a-z0-9а-яё]+")


def counted(chunks: DataFrame, *names: str) -> DataFrame:
    """names, terms, tfs, dl: each chunk's distinct terms with their frequencies, and its length in terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [TERM.findall(x or "") for x in batch.column("_low").to_pylist()]
            lengths = np.array([len(x) for x in lists], np.int32)
            tokens = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
            kinds = max(len(tokens.dictionary), 1)
            pairs, tfs = np.unique(np.repeat(np.arange(len(batch)), lengths) * kinds + tokens.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(batch) + 1) * kinds), pa.int32())
            terms = pa.ListArray.from_arrays(ends, tokens.dictionary.take(pa.array(pairs % kinds)))
            counts = pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], terms, counts, pa.array(lengths)], names=[*names, "terms", "tfs", "dl"])

    kinds = ", ".join(f"`{n}` {chunks.schema[n].dataType.simpleString()}" for n in names)
    return chunks.select(*names, F.lower("chunk").alias("_low")).mapInArrow(run, f"{kinds}, terms array<string>, tfs array<int>, dl int")


def postings(chunks: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Term frequencies with the scope's statistics: df, number of chunks, average length."""
    keys = list(dict.fromkeys([*scope, key, "chunk_index"]))
    rows = counted(chunks, *keys)
    return _measured(_exploded(rows, *keys, "dl"), rows, scope, keys)


def _exploded(rows: DataFrame, *names: str) -> DataFrame:
    each = rows.select(*names, F.explode(F.arrays_zip("terms", "tfs")).alias("_p"))
    return each.select(*names, F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf"))


def _measured(each: DataFrame, rows: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    stats = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("_all"))
    tf = each.groupBy(*keys, "dl", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(df, [*scope, "term"])
    return joined.join(stats, scope) if scope else joined.crossJoin(F.broadcast(stats))


@dataclass(frozen=True)
class Wanted:
    """Postings of the terms that queries have, and all chunks (key, chunk_index, dl): what a few queries need of a corpus."""

    posts: DataFrame
    chunks: DataFrame


def wanted_postings(chunks: DataFrame, key: str, queries: DataFrame) -> Wanted:
    """`postings` of one corpus for the terms of queries alone, with the statistics of all chunks, from one pass over them."""
    folder = scratch(chunks.sparkSession, "postings")
    # Stored, so that the planner knows how small it is.
    terms = stored(queries.select(F.explode(t.tokens(F.col("query"))).alias("term")).distinct(), f"{folder}/terms")
    # A row without a term stands for the chunk itself.
    rows = counted(chunks, key, "chunk_index").withColumn("terms", F.concat("terms", F.array(F.lit(None).cast("string"))))
    each = _exploded(rows, key, "chunk_index", "dl")
    known = each.join(terms.withColumn("_known", F.lit(True)), "term", "left").where("_known OR term IS NULL").select(key, "chunk_index", "dl", "term", "tf")
    held = stored(known, f"{folder}/held")
    every = held.where("term IS NULL").select(key, "chunk_index", "dl")
    return Wanted(_measured(held.where("term IS NOT NULL"), every, [], [key, "chunk_index"]), every)


def top_k(queries: DataFrame, posts: DataFrame, scope: list[str], key: str, k: int = 3) -> DataFrame:
    """The k best chunks of each query (query_id, query), by score, then order in the corpus; scores over 0 only."""
    terms = queries.select("query_id", *scope, F.explode(t.tokens(F.col("query"))).alias("term")).groupBy("query_id", *scope, "term").agg(F.count(F.lit(1)).alias("qf"))
    idf = F.log(F.greatest((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5), F.lit(1e-5)) + 1)
    length = F.col("dl") / (F.greatest(F.col("_all"), F.lit(1)) / F.col("n_chunks"))
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    hits = terms.join(posts, [*scope, "term"]).withColumn("_part", part.cast(CONTRIBUTION))
    scores = hits.groupBy("query_id", key, "chunk_index").agg(F.sum("_part").cast("decimal(28,6)").alias("_score")).where("_score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_score"), key, "chunk_index"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "chunk_index", F.col("_score").cast("double").alias("score"))


def top_k_or_first(queries: DataFrame, posts: DataFrame, chunks: DataFrame, key: str, k: int = 3) -> DataFrame:
    """`top_k` over one corpus, where a query without terms gets the corpus's first k chunks with score 0."""
    none = queries.where(F.size(t.tokens(F.coalesce("query", F.lit("")))) == 0).select("query_id")
    first = chunks.select(key, "chunk_index").orderBy(key, "chunk_index").limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(key, "chunk_index")))  # k rows
    found = none.crossJoin(F.broadcast(ranked)).select("query_id", "rank", key, "chunk_index", F.lit(0.0).alias("score"))
    return top_k(queries, posts, [], key, k).unionByName(found)


def inverted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, positions. Texts are dealt by key as they are, so that their words needn't move."""
    words = docs.select(key, text).repartition(key).select(key, F.posexplode(t.word_list(F.col(text))).alias("_p", "word"))
    return words.groupBy(key, "word").agg(F.sort_array(F.collect_list("_p")).alias("positions"))


def rebuilt(index: DataFrame, key: str) -> DataFrame:
    """The text of each inverted index: words by position, gaps skipped, joined by a space."""
    # Words are gathered with all their positions, which are placed within the row.
    words = index.groupBy(key).agg(F.collect_list(F.struct("word", "positions")).alias("_w"))
    placed = F.flatten(F.transform("_w", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("_p"), x["word"].alias("word")))))
    return words.select(key, F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ").alias("text"))
