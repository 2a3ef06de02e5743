"""BM25 of a checked number of queries by two passes over the chunks, without moving postings.

Queries that every task can carry need no index: the first pass cuts texts into chunks and keeps their counts of the
queries' terms, which give the corpus's statistics; the second scores each chunk for all queries and keeps the k best of
each. Sums in floating point say which chunks can be among these; their scores are then added exactly, in the decimals
that `retrieval.top_k` uses. More queries than that search an impact index.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.operators import impact_index
from veracol.operators.retrieval import K1, TERM, B, chunked
from veracol.sources.stored import scratch, stored

#: Pairs of a query and a term that tasks carry.
CARRIED = 100_000
#: Chunks that are counted at once, and counters (chunks by queries) that a task holds at once.
CHUNKS, COUNTERS = 10_000, 1 << 19
#: Python's white space that `text.SPACE` isn't.
_NO_SPACE = "\x1c\x1d\x1e\x1f\x85"
_SPACE = re.compile(f"[^\\S{_NO_SPACE}]+")


def windows(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    """`text.chunks` of one text."""
    clean = _SPACE.sub(" ", text).strip(" ") if any(c in text for c in _NO_SPACE) else " ".join(text.split())
    if len(clean) <= size:
        return [clean] if clean else []
    return [clean[i : i + size].strip(" ") for i in range(0, len(clean), size - overlap)]


def _counted(docs: DataFrame, key: str, text: str, codes: dict[str, int]) -> DataFrame:
    """key, chunk_index, dl, codes, tfs: each chunk's length in terms, and how often it has the terms that have a code."""
    kinds = max(len(codes), 1)

    def rows(keys: pa.Array, owner: list[int], index: list[int], lengths: list[int], found: array) -> pa.RecordBatch:
        lengths, found = np.array(lengths, np.int32), np.frombuffer(found, np.int32) if found else np.zeros(0, np.int32)
        pairs = (np.repeat(np.arange(len(lengths)) * kinds, lengths) + found)[found >= 0]
        pairs, tfs = np.unique(pairs, return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(lengths) + 1) * kinds), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % kinds, tfs)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), pa.array(index, pa.int32()), pa.array(lengths), *lists], names=[key, "chunk_index", "dl", "codes", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, index, lengths, found = [], [], [], array("i")
            for row, x in enumerate(batch.column(1)):
                for i, chunk in enumerate(windows(x.as_py() or "")):
                    terms = TERM.findall(chunk.lower())
                    found.extend(map(codes.get, terms, repeat(-1)))
                    owner.append(row), index.append(i), lengths.append(len(terms))
                    if len(owner) == CHUNKS:
                        yield rows(batch.column(0), owner, index, lengths, found)
                        owner, index, lengths, found = [], [], [], array("i")
            if owner:
                yield rows(batch.column(0), owner, index, lengths, found)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, dl int, codes array<int>, tfs array<int>")


def _billionths(parts: np.ndarray) -> np.ndarray:
    """Parts as whole billionths, rounded as a cast to a decimal rounds: half up, by the digits that a number is written with."""
    scaled = parts * 1e9
    out = np.rint(scaled)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3 + scaled * 1e-15):
        out[i] = int(Decimal(repr(float(parts[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _scored(counted: DataFrame, key: str, weights: list[tuple[int, int, float]], mean: float, k: int) -> DataFrame:
    """query, key, chunk_index and score (in millionths) of each task's k best chunks of each query.

    weights: number of the query, code of the term and its weight, by code.
    """
    who, codes, weight = np.array([w[0] for w in weights], np.int64), np.array([w[1] for w in weights], np.int64), np.array([w[2] for w in weights])
    queries = int(who.max()) + 1
    # What the sums in floating point may be off by, and what rounding to billionths and millionths may bring.
    slack = 1e-5 + 1e-9 * int(np.bincount(who).max())
    order = [("query", "ascending"), ("score", "descending"), (key, "ascending"), ("chunk_index", "ascending")]
    step = max(1, COUNTERS // queries)

    def candidates(rows: pa.RecordBatch, least: np.ndarray) -> pa.Table:
        """The chunks that may be among the k best, with their exact scores. least: a score of each query that k chunks have."""
        n = len(rows)
        sizes = pc.list_value_length(rows.column("codes")).to_numpy(zero_copy_only=False)
        code, tf = (rows.column(c).flatten().to_numpy() for c in ("codes", "tfs"))
        row = np.repeat(np.arange(n), sizes)
        below = tf + K1 * (1 - B + B * (rows.column("dl").to_numpy() / mean))[row]
        first = np.searchsorted(codes, code)
        asked = np.searchsorted(codes, code, "right") - first
        post = np.repeat(np.arange(len(code)), asked)
        at = np.arange(len(post)) + (first - np.cumsum(asked) + asked)[post]
        place = (row * queries)[post] + who[at]
        sums = np.bincount(place, weight[at] * (tf * (K1 + 1) / below)[post], n * queries).reshape(n, queries)
        bound, new = least / 1e6, least == 0
        if n > k and new.any():
            bound[new] = np.partition(sums[:, new], n - k, axis=0)[n - k]
        able = (sums > 0) & (sums >= bound - slack)
        places, hit = np.flatnonzero(able), np.flatnonzero(able.ravel()[place])
        post, at = post[hit], at[hit]
        exact = _billionths(weight[at] * tf[post] * (K1 + 1) / below[post])
        score = (np.bincount(np.searchsorted(places, place[hit]), exact, len(places)).astype(np.int64) + 500) // 1000
        places, score = places[score > 0], score[score > 0]
        chunk = rows.select([key, "chunk_index"]).take(pa.array(places // queries))
        return pa.table([pa.array(places % queries, pa.int64()), *chunk.columns, pa.array(score, pa.int64())], names=["query", key, "chunk_index", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = None, np.zeros(queries, np.int64)
        for batch in batches:
            for begin in range(0, len(batch), step):
                found = candidates(batch.slice(begin, step), least)
                if not len(found):
                    continue
                best = found if best is None else pa.concat_tables([best, found])
                best = best.take(pc.sort_indices(best, order, null_placement="at_start"))
                query = best.column("query").to_numpy()
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                least[query[rank == k - 1]] = best.column("score").to_numpy()[rank == k - 1]
                best = best.filter(pa.array(rank < k)).combine_chunks()
        if best is not None:
            yield from best.to_batches()

    return counted.mapInArrow(run, f"query long, `{key}` {counted.schema[key].dataType.simpleString()}, chunk_index int, score long")


def search(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """The k best chunks of each query (query_id, query) over the texts, by score, then order in the corpus; scores over 0 only."""
    spark = docs.sparkSession
    asked = queries.select("query_id", F.explode(t.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    pairs = asked.limit(CARRIED + 1).collect()
    if len(pairs) > CARRIED:
        return impact_index.search(queries, impact_index.built(chunked(docs, key, text), key), k).best
    codes = {term: i for i, term in enumerate(sorted({r.term for r in pairs}))}
    ids = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in pairs))}
    counted = stored(_counted(docs, key, text, codes), f"{scratch(spark, 'scan')}/chunks")
    n_chunks, n_tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    # As Spark computes the logarithms, to the last bit.
    idf = F.log(F.greatest((F.lit(n_chunks).cast("long") - F.col("df") + 0.5) / (F.col("df") + 0.5), F.lit(1e-5)) + 1)
    known = {r.code: r.idf for r in counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).select("code", idf.alias("idf")).collect()}
    weights = sorted(((ids[r.query_id], codes[r.term], r.qf * known[codes[r.term]]) for r in pairs if codes[r.term] in known), key=lambda w: w[1])
    names = spark.createDataFrame([(i, q) for q, i in ids.items()], f"query long, query_id {queries.schema['query_id'].dataType.simpleString()}")
    if not weights:
        return names.limit(0).crossJoin(counted.limit(0)).select("query_id", F.lit(0).alias("rank"), key, "chunk_index", F.lit(0.0).alias("score"))
    found = _scored(counted, key, weights, max(n_tokens, 1) / n_chunks, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key, "chunk_index"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "query")
    return best.select("query_id", "rank", key, "chunk_index", (F.col("score") / 1e6).alias("score"))
