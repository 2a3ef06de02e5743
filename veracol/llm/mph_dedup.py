"""Exact deduplication against a minimal perfect hash over historical distinct digests.

Rows become digests of their normalised text. The history (earlier batches) is kept as a table of its distinct
digests, one row a shard: a minimal perfect hash whose slots hold the full digest and the winner's locator.
A new batch is reduced to one row per digest where it is read, and each of those is looked up: a slot whose
stored digest is equal, byte by byte, marks a repeat of history; the others group among themselves.

Defined cases: null text counts as empty, and equal to it; texts of any length are digested whole; among
rows of one text the smallest doc_id wins (null doc_id last), repeated rows included; an empty table gives
an empty result; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.llm.common import GAP, text_or_empty, written

#: Bits a level of the hash has for each key that reaches it.
GAMMA = 2.0
#: Digests in a shard, about; a shard is what one task holds at a time.
SHARD_DIGESTS = 20_000
DIGEST_BYTES = 32
_M = np.uint64(0xFF51AFD7ED558CCD)

#: A shard's row of the index: the hash's levels (bits of settled places), then slot by slot digest, winner, whether
#: that is an id, and row count.
INDEX = "shard long, slots long, levels array<struct<size:long,bits:binary>>, digests binary, winners binary, named binary, counts binary"
_LEVELS = pa.list_(pa.struct([("size", pa.int64()), ("bits", pa.binary())]))
_ARROW_INDEX = pa.schema([("shard", pa.int64()), ("slots", pa.int64()), ("levels", _LEVELS), *[(c, pa.binary()) for c in ("digests", "winners", "named", "counts")]])


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space replaced by one space."""
    return F.sha2(F.regexp_replace(text, GAP, " ").cast("binary"), 256)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        x ^= x >> np.uint64(33)
        x *= _M
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Numbers n distinct 64-bit keys 0..n-1 without storing them.

    Level by level, keys that are alone at their place are settled there; the others go on to a smaller
    level. The number of a key is the count of settled places before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rest, total = keys.astype(np.uint64), 0
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            place = (_mixed(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            self.levels.append(taken)
            self.before.append(total + np.cumsum(taken) - taken)
            total += int(taken.sum())
            rest = rest[~taken[place]]

    @classmethod
    def stored(cls, levels: list[np.ndarray]) -> PerfectHash:
        """The hash whose levels are these."""
        out, total = cls(np.zeros(0, np.uint64)), 0
        for taken in levels:
            out.levels.append(taken)
            out.before.append(total + np.cumsum(taken) - taken)
            total += int(taken.sum())
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it; a key outside the set can get any slot."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, before) in enumerate(zip(self.levels, self.before, strict=True)):
            place = (_mixed(keys[left], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[place]
            out[left[hit]] = before[place[hit]]
            left = left[~hit]
        return out


def _keys(raw: np.ndarray) -> np.ndarray:
    """64 bits of each digest: within a set that has two digests with equal ones, the build would not end."""
    words = np.ascontiguousarray(raw).view(np.uint64).reshape(len(raw), 4)
    return words[:, 0] ^ (words[:, 1] * np.uint64(3))


def _raw(column: pa.Array) -> np.ndarray:
    """The digests of a column, one row of 32 bytes each."""
    ends, data = np.frombuffer(column.buffers()[1], np.int32), column.buffers()[2]
    first = int(ends[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * DIGEST_BYTES, first).reshape(-1, DIGEST_BYTES)


class Index:
    """A shard's hash with its slots: full digest, winner (0 where none has an id) and row count.

    Digests whose 64-bit keys clash with another's have no slot; they follow the slots and are looked up by
    their bytes.
    """

    def __init__(self, hashed: PerfectHash, digests: np.ndarray, winner: np.ndarray, named: np.ndarray, n: np.ndarray, slots: int):
        self.hash, self.digests, self.winner, self.named, self.n, self.slots = hashed, digests, winner, named, n, slots
        self.spare = {d.tobytes(): slots + i for i, d in enumerate(digests[slots:])}
        self.seen = np.zeros(len(digests), bool)

    @classmethod
    def of(cls, raw: np.ndarray, winner: np.ndarray, named: np.ndarray, n: np.ndarray) -> Index:
        keys = _keys(raw)
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        hashed = PerfectHash(keys[first])
        order = np.empty(int(first.sum()), np.int64)
        order[hashed.slots(keys[first])] = np.flatnonzero(first)
        order = np.r_[order, np.flatnonzero(~first)]
        return cls(hashed, raw[order], winner[order], named[order], n[order], int(first.sum()))

    def row(self, shard: int) -> dict:
        levels = [{"size": len(x), "bits": np.packbits(x).tobytes()} for x in self.hash.levels]
        return {"shard": shard, "slots": self.slots, "levels": levels, "digests": self.digests.tobytes(), "winners": self.winner.tobytes(), "named": np.packbits(self.named).tobytes(), "counts": self.n.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Index:
        hashed = PerfectHash.stored([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["size"]).astype(bool) for x in row["levels"]])
        winner = np.frombuffer(row["winners"], np.int64).copy()
        named = np.unpackbits(np.frombuffer(row["named"], np.uint8), count=len(winner)).astype(bool)
        return cls(hashed, np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST_BYTES), winner, named, np.frombuffer(row["counts"], np.int64).copy(), row["slots"])

    def find(self, raw: np.ndarray) -> np.ndarray:
        """The place of each digest, -1 for nonmembers."""
        slot = self.hash.slots(_keys(raw))
        member = slot >= 0
        member[member] = (self.digests[slot[member]] == raw[member]).all(axis=1)
        slot[~member] = -1
        if self.spare:
            for i in np.flatnonzero(~member):
                slot[i] = self.spare.get(raw[i].tobytes(), -1)
        return slot

    def add(self, at: np.ndarray, winner: np.ndarray, named: np.ndarray, n: np.ndarray) -> None:
        """Count rows (of distinct digests) at known places; the smaller winner stays."""
        self.n[at] += n
        self.seen[at] = True
        better = named & (~self.named[at] | (winner < self.winner[at]))
        self.winner[at[better]] = winner[better]
        self.named[at] |= named


def digested(docs: DataFrame) -> DataFrame:
    """doc_id and digest (32 bytes) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(text_or_empty())).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Each distinct digest with its smallest doc_id and row count, summed before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards))


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of rows that are equal in all columns."""
    if len(columns[0]):
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
        yield from zip(edges, edges[1:], strict=False)


def _winners_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    winner = batch.column("winner")
    return winner.fill_null(0).to_numpy(zero_copy_only=False), np.array(winner.is_valid()), batch.column("n").fill_null(0).to_numpy(zero_copy_only=False)


def built(history: DataFrame, shards: int) -> DataFrame:
    """The index of a history (digest, winner, n; one row per digest): one row per shard, to be kept as a table.

    A shard holds the digests whose leading 48 bits leave one remainder; digests spread evenly, however often
    one of them occurs.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                index = Index.of(*[np.concatenate(x) for x in zip(*held, strict=True)])
                yield pa.RecordBatch.from_pylist([index.row(current)], _ARROW_INDEX)

        for batch in batches:
            shard, columns = batch.column("shard").to_numpy(), (_raw(batch.column("digest")), *_winners_of(batch))
            for a, b in _runs(shard):
                if shard[a] != current:
                    yield from done()
                    current, held = int(shard[a]), []
                held.append([x[a:b] for x in columns])
        yield from done()

    rows = history.select(_shard(shards).alias("shard"), "digest", "winner", "n")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, INDEX)


def merged(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Digests after a batch: digest, winner, n, and repeat (in the history and in the batch).

    index is what `built` made with the same number of shards; batch has digest, winner, n, one row per digest.
    A shard's index comes first, then the batch's digests stream past it, then its slots are given out.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, None

        def rows(raw: np.ndarray, winner: np.ndarray, named: np.ndarray, n: np.ndarray, repeat: np.ndarray) -> pa.RecordBatch:
            ends = np.arange(0, raw.size + 1, DIGEST_BYTES, dtype=np.int32)
            digests = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
            return pa.RecordBatch.from_arrays([digests, pa.array(winner, mask=~named), pa.array(n), pa.array(repeat)], names=["digest", "winner", "n", "repeat"])

        for batch in batches:
            shard, later = batch.column("shard").to_numpy(), np.array(batch.column("slots").is_null())
            for a, b in _runs(shard, later):
                part = batch.slice(a, b - a)
                if not later[a]:
                    for row in part.to_pylist():
                        if index is not None:
                            yield rows(index.digests, index.winner, index.named, index.n, index.seen)
                        current, index = row["shard"], Index.read(row)
                    continue
                raw, (winner, named, n) = _raw(part.column("digest")), _winners_of(part)
                at = index.find(raw) if index is not None and current == shard[a] else np.full(len(raw), -1)
                known = at >= 0
                if known.any():
                    index.add(at[known], winner[known], named[known], n[known])
                if not known.all():
                    new = ~known
                    yield rows(raw[new], winner[new], named[new], n[new], np.zeros(int(new.sum()), bool))
        if index is not None:
            yield rows(index.digests, index.winner, index.named, index.n, index.seen)

    new = batch.select(_shard(shards).alias("shard"), "digest", "winner", "n")
    both = index.unionByName(new, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", F.col("slots").isNull()).mapInArrow(look_up, "digest binary, winner long, n long, repeat boolean")


def shard_count(spark: SparkSession, digests: int) -> int:
    """Enough shards that each holds about SHARD_DIGESTS, and several for each task."""
    return max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), digests // SHARD_DIGESTS)


def _resolved(rows: DataFrame, history: DataFrame | None, shards: int | None) -> DataFrame:
    """_digest, _winner, _n of each digest of more than one row. rows: doc_id and digest, as a written table."""
    if history is None:
        second = F.xxhash64("doc_id") % 2 == 0
        shards = shard_count(rows.sparkSession, rows.count())
        first = winners(rows.where(~second | F.col("doc_id").isNull()))
        history, batch = written(built(first, shards), "digest_index"), winners(rows.where(second & F.col("doc_id").isNotNull()))
    else:
        batch = winners(rows)
    known = merged(history, batch, shards)
    return written(known.where("n > 1").select(F.col("digest").alias("_digest"), F.col("winner").alias("_winner"), F.col("n").alias("_n")), "repeated")


def grouped(docs: DataFrame, history: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """Every row with its text's winner: doc_id, keep_id, group_size, kept, text_sha256.

    history: the index of earlier batches, as `built` made it with so many shards. Without one the table is
    taken as two batches, the first of which is the history of the second. Rows of a text that occurs once
    keep themselves; the rest are joined to the winners of repeated digests, whose hot keys adaptive execution
    can split.
    """
    rows = written(digested(docs), "digests")
    repeated = _resolved(rows, history, shards)
    joined = rows.join(repeated, F.col("digest") == F.col("_digest"), "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_winner"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each text, the smallest doc_id's, with the input's columns.

    Rows are told apart by text, so that texts of one doc_id, or of none, all stay; rows of one text that
    repeat the winner's doc_id are reduced to one. What goes is found on ids and digests alone, so that whole
    documents are shuffled once, to meet the list of losers.
    """
    rows = written(digested(docs), "digests")
    repeated = _resolved(rows, None, None)
    pairs = rows.join(repeated, F.col("digest") == F.col("_digest")).groupBy("digest", "doc_id", "_winner").agg(F.count(F.lit(1)).alias("_rows"))
    pairs = written(pairs.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), F.col("doc_id").eqNullSafe(F.col("_winner")).alias("_wins"), "_rows"), "repeated_ids")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.unhex(digest(text_or_empty())).alias("_text"))
    same = (F.col("_text") == F.col("_digest")) & F.col("_doc").eqNullSafe(F.col("_id"))
    # The list of losers grows with the input: a sort-merge join at every size.
    kept = whole.join(pairs.where("NOT _wins OR _rows > 1").hint("merge"), same, "left_anti")
    tied = pairs.where("_wins AND _rows > 1")
    if not tied.isEmpty():
        kept = kept.unionByName(whole.join(tied, same, "left_semi").dropDuplicates(["_text"]))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents),
g AS (SELECT digest, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY digest)
SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, digest AS text_sha256 FROM d JOIN g USING (digest)
"""
