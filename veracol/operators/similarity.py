"""Similarity of texts by character n-grams.

A library of checked size becomes an inverted index that every task carries; texts stream past it and their shared
grams are counted batch by batch, without a shuffle: grams that many library rows have by a product of matrices, the others
row by row. A larger library is joined on the rarest grams of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.functions import text as t

THRESHOLD = 0.45
#: Grams are ordered by how often their bucket occurs in the library; a fixed number of buckets, whatever its size.
BUCKETS = 1 << 14
#: Rows and characters up to which a library is carried as an index.
CARRIED_ROWS, CARRIED_CHARS = 4096, 4_000_000
#: Counters (texts by library rows), and entries of a matrix of texts by frequent grams, that a task holds at once.
COUNTERS, ENTRIES = 1 << 22, 1 << 21
#: Grams are frequent that one in so many library rows has; so their matrix has at most as many entries for each posting.
ONE_IN = 8


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def bucket_counts(words: DataFrame, word: str) -> Column:
    """A constant array: how many rows have a word of each bucket."""
    found = [0] * BUCKETS
    for r in words.groupBy(bucket(F.col(word)).alias("b")).count().collect():  # BUCKETS rows at most
        found[r.b] = r["count"]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<long>")


def _frequencies(library: DataFrame, text: str) -> Column:
    """A constant array: how many library texts have a gram of each bucket."""
    return bucket_counts(library.select(F.explode(t.grams(F.col(text))).alias("g")), "g")


def _prefixes(rows: DataFrame, names: list[str], text: str, often: Column, threshold: float) -> DataFrame:
    """names, _n (number of grams), _at and _gram of each row's rarest grams: one of them at least is shared with
    any row that is more similar than the threshold."""
    ranked = F.sort_array(F.transform("_g", lambda g: F.struct(F.get(often, bucket(g)).alias("f"), g.alias("g"))))
    rows = rows.select(*names, t.grams(F.col(text)).alias("_g"))
    rows = rows.select(*names, F.size("_g").alias("_n"), ranked.alias("_r")).where("_n > 0")
    kept = F.expr(f"slice(_r, 1, CAST(_n - ceil({threshold} * _n - 1e-9) + 1 AS INT))")
    rows = rows.select(*names, "_n", F.posexplode(kept).alias("_at", "_x"))
    return rows.where("_x.f > 0").select(*names, "_n", "_at", F.col("_x.g").alias("_gram"))


def _prefix_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, left_key: list[str], right_key: list[str], threshold: float) -> DataFrame:
    """Pairs of rows whose Jaccard similarity of 3-grams exceeds the threshold, with `similarity`.

    Keys alone meet on the rarest grams of each text (the library `right` says which are rare). A meeting counts
    only where the sizes, and the grams that can still be shared from there on, allow the threshold. Texts are
    fetched for such candidates, which are then compared whole.
    """
    often = _frequencies(right, right_text)
    names = [[f"_{side}{i}" for i in range(len(key))] for side, key in (("l", left_key), ("r", right_key))]
    sides = [df.select(*[F.col(c).alias(n) for c, n in zip(key, own, strict=True)], F.col(text).alias("_text")) for df, key, own, text in ((left, left_key, names[0], left_text), (right, right_key, names[1], right_text))]
    rows = [_prefixes(df, own, "_text", often, threshold) for df, own in zip(sides, names, strict=True)]
    other = rows[1].withColumnsRenamed({"_n": "_m", "_at": "_to"})
    near = f"least(_n, _m) > {threshold} * greatest(_n, _m) AND 1 + least(_n - 1 - _at, _m - 1 - _to) >= {threshold} / (1 + {threshold}) * (_n + _m) - 1e-9"
    pairs = rows[0].join(other, "_gram").where(near).select(*names[0], *names[1]).distinct()
    whole = [df.withColumn(side, F.struct(*[F.col(c) for c in df.columns])).select(*[F.col(c).alias(f"_{n}") for c, n in zip(key, own, strict=True)], side, t.grams(F.col(text)).alias(f"_g{side}")) for df, side, key, own, text in ((left, "_l", left_key, names[0], left_text), (right, "_r", right_key, names[1], right_text))]
    for df, own in zip(whole, names, strict=True):
        pairs = pairs.join(df, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in own]))
    both = F.size(F.array_intersect("_g_l", "_g_r"))
    similar = pairs.withColumn("similarity", both / (F.size("_g_l") + F.size("_g_r") - both)).where(F.col("similarity") > threshold)
    return similar.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in right.columns], "similarity")


def _gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 63-bit key of each distinct gram of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = of[2:] == of[:-2]
    # Characters by their place among those that occur, so that text and gram fit one number.
    letters = np.flatnonzero(np.bincount(codes))
    n = len(letters)
    if len(texts) * n**3 < 1 << 63:
        place = np.zeros(letters[-1] + 1, np.int64)
        place[letters] = np.arange(n)
        codes = place[codes]
        pairs = np.sort((((of[:-2] * n + codes[:-2]) * n + codes[1:-1]) * n + codes[2:])[whole])
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        pairs, third = np.divmod(pairs, n)
        pairs, second = np.divmod(pairs, n)
        row, first = np.divmod(pairs, n)
        return row, (letters[first] << 42 | letters[second] << 21 | letters[third]).astype(np.uint64)
    keys = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]).astype(np.uint64)[whole]
    known, number = np.unique(keys, return_inverse=True)
    pairs = np.unique(of[:-2][whole] * max(1, len(known)) + number)
    return pairs // max(1, len(known)), known[pairs % max(1, len(known))]


class _Index:
    """Library rows by gram."""

    def __init__(self, texts: list[str]):
        row, key = _gram_keys(texts)
        self.sizes = np.bincount(row, minlength=len(texts))
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.rows, self.first = row[order], np.r_[first, len(key)]
        found = np.diff(self.first)
        frequent = found * ONE_IN >= len(texts)
        #: Row of the matrix for each frequent gram, else -1.
        self.line = np.where(frequent, np.cumsum(frequent) - 1, -1)
        # Counts stay below 2 ** 24, so that single precision adds them exactly.
        self.matrix = np.zeros((frequent.sum(), len(texts)), np.float32)
        line = np.repeat(self.line, found)
        self.matrix[line[line >= 0], self.rows[line >= 0]] = 1

    def _shared(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Grams (row: text, at: gram) that each of n texts shares with each library row. Texts come in order."""
        line = self.line[at]
        often, lines = row[line >= 0], line[line >= 0]
        out, step = np.empty((n, len(self.sizes)), np.float32), max(1, ENTRIES // max(1, len(self.matrix)))
        for a in range(0, n, step):
            z = min(a + step, n)
            part = slice(*np.searchsorted(often, [a, z]))
            has = np.zeros((z - a, len(self.matrix)), np.float32)
            has[often[part] - a, lines[part]] = 1
            np.matmul(has, self.matrix, out=out[a:z])
        row, at = row[line < 0], at[line < 0]
        found = self.first[at + 1] - self.first[at]
        nth = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        np.add.at(out, (np.repeat(row, found), self.rows[np.repeat(self.first[at], found) + nth]), np.float32(1))
        return out

    def similar(self, texts: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, library row and similarity of each pair above the threshold."""
        step = max(1, COUNTERS // max(1, len(self.sizes)))
        for begin in range(0, len(texts), step):
            part = texts[begin : begin + step]
            row, key = _gram_keys(part)
            size = np.bincount(row, minlength=len(part))
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            shared = self._shared(row[hit], at[hit], len(part))
            # A similarity is at most the share of the text's own grams.
            able = np.flatnonzero((size > 0) & (shared.max(axis=1, initial=0) >= threshold * size - 1e-6))
            shared = shared[able].astype(np.int64)
            ratio = shared / np.maximum(size[able, None] + self.sizes[None, :] - shared, 1)
            text, other = np.nonzero(ratio > threshold)
            yield able[text] + begin, other, ratio[text, other]


def _carried_join(left: DataFrame, rows: list, library: DataFrame, left_text: str, threshold: float) -> DataFrame:
    index = _Index([r.clean for r in rows])
    schema = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(0).cast("long").alias("_at"), F.lit(0.0).alias("similarity")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, other, ratio in index.similar([x or "" for x in batch.column("clean").to_pylist()], threshold):
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column("_l").take(pa.array(text)), pa.array(other.astype(np.int64)), pa.array(ratio)], names=["_l", "_at", "similarity"])

    found = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_l"), t.letters(F.col(left_text)).alias("clean")).mapInArrow(run, schema)
    wide = library.sparkSession.createDataFrame([(i, r.row) for i, r in enumerate(rows)], f"_to long, row {library.select(F.struct(*library.columns)).schema[0].dataType.simpleString()}")
    return found.join(wide, F.col("_at") == F.col("_to")).select("_l.*", *[F.col(f"row.{c}").alias(c) for c in library.columns], "similarity")


def gram_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, left_key: list[str], right_key: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of rows whose Jaccard similarity of 3-grams exceeds the threshold, with `similarity`."""
    rows = right.select(F.struct(*[F.col(c) for c in right.columns]).alias("row"), F.coalesce(t.letters(F.col(right_text)), F.lit("")).alias("clean"))
    size = right.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(right_text).cast("long")).alias("chars")).first()
    if size.n <= CARRIED_ROWS and (size.chars or 0) <= CARRIED_CHARS:
        return _carried_join(left, rows.collect(), right, left_text, threshold) if size.n else _prefix_join(left, right, left_text, right_text, left_key, right_key, threshold)
    return _prefix_join(left, right, left_text, right_text, left_key, right_key, threshold)


def source_flags(sentences: DataFrame, library: DataFrame, key: list[str], order: str, threshold: float = THRESHOLD) -> DataFrame:
    """The first library row (by `order`) that each sentence is like: a gap without a citation, else a paraphrase."""
    pairs = gram_join(sentences.select(*key, "sentence"), library, "sentence", "text", key, [order], threshold)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    cited = F.col("sentence").contains("[")
    return pairs.withColumn("_k", first).where("_k = 1").select(
        *key,
        order,
        "similarity",
        F.when(cited, "semantic_plagiarism_risk").otherwise("citation_gap").alias("issue_type"),
        F.when(cited, "medium").otherwise("high").alias("severity"),
    )
