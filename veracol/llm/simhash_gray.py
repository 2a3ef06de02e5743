"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints that share enough bits to be able to link meet in a bucket (pigeonhole over blocks of bits, so
no link is missed). A bucket's fingerprints, sorted by Gray rank, form the leaves of a tree whose nodes hold
the bits common to all below them and not yet held above; a search adds up the differences to those patterns
on its way down and leaves a whole group as soon as the sum is too large. Buckets report only which
fingerprints hang together, never their pairs, and star contraction joins those reports to components.

Defined cases: null or empty text, or white space alone, has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; equal texts share one fingerprint, which is looked up once,
however many rows have it; a component is named by its smallest doc_id (null only if it has no other); an
empty table gives an empty result; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracol.llm.common import discard, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Children of a node.
FANOUT = 16
#: Members of a bucket that the length of the keys aims at.
BUCKET_ROWS = 1024
#: Members of a bucket above which it is searched in blocks, pair by pair.
BLOCK_ROWS = 8192
#: Pairs at most that queries which descend together can bring.
PAIRS_AT_ONCE = 1 << 20
#: Rows searched together (whole groups).
ROWS_AT_ONCE = 16384


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of lower-case words, repeats included; none without a word."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle_words, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero without a hash."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (its 64 bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def bit_keys(distinct: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks such that two codes at most max_bits apart agree on one of them at least.

    The codes are cut into blocks; all but max_bits of the blocks agree. More blocks make longer keys, so
    that a bucket stays small as the number of codes grows.
    """
    for extra in (1, 2, 3):
        n = max_bits + extra
        edges = [64 * i // n for i in range(n + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(blocks, extra)]
        if distinct >> min(m.bit_count() for m in masks) < BUCKET_ROWS:
            break
    return masks


class GrayTree:
    """Hierarchical index over codes sorted by (group, Gray rank); each group has a root of its own."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.codes = codes
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[first, len(codes)])
        self.group = np.repeat(np.arange(len(first)), sizes)
        low = high = codes
        #: From the leaves up: (pattern, mask, first child, end of children) of each level's nodes.
        self.levels: list[list[np.ndarray]] = []
        while True:
            nodes = -(-sizes // FANOUT)
            start = np.r_[0, np.cumsum(sizes)]
            ends_at = np.repeat(start[1:], nodes)
            nth = np.arange(nodes.sum()) - np.repeat(np.r_[0, np.cumsum(nodes)][:-1], nodes)
            begin = np.repeat(start[:-1], nodes) + FANOUT * nth
            low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
            self.levels.append([low, ~(low ^ high), begin, np.minimum(begin + FANOUT, ends_at)])
            sizes = nodes
            if (nodes == 1).all():
                break
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            parent = np.repeat(np.arange(len(above[2])), above[3] - above[2])
            below[1] = below[1] & ~above[1][parent]

    def links(self, query: np.ndarray, max_bits: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a row of query, a later row of its group) at most max_bits apart that root doesn't join yet.

        A node goes too where all below it hang together with the query already.
        """
        node, gone = self.group[query], np.zeros(len(query), np.uint8)
        low_root = high_root = root
        joined = []
        for _, _, begin, _ in self.levels:
            low_root, high_root = np.minimum.reduceat(low_root, begin), np.maximum.reduceat(high_root, begin)
            joined.append(np.where(low_root == high_root, low_root, -1))
        for (low, mask, begin, end), one in zip(reversed(self.levels), reversed(joined), strict=True):
            gone = gone + np.bitwise_count((self.codes[query] ^ low[node]) & mask[node])
            stay = (gone <= max_bits) & (one[node] != root[query])
            query, node, gone = query[stay], node[stay], gone[stay]
            children = end[node] - begin[node]
            nth = np.arange(children.sum()) - np.repeat(np.cumsum(children) - children, children)
            query, gone, node = np.repeat(query, children), np.repeat(gone, children), np.repeat(begin[node], children) + nth
        near = (node > query) & (np.bitwise_count(self.codes[query] ^ self.codes[node]) <= max_bits)
        return query[near], node[near]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after joining the trees of each pair."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _group_links(groups: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each group, every code that links to others, with the least-placed one it hangs together with."""
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    tree, root = GrayTree(groups, codes), np.arange(len(codes))
    # A few queries first, which join the members of tight groups; then as many as bounded memory allows.
    largest, at, step = int(np.bincount(tree.group).max()), 0, 16
    while at < len(codes):
        root = _united(root, *tree.links(np.arange(at, min(at + step, len(codes))), max_bits, root))
        at += step
        step = min(4 * step, max(16, PAIRS_AT_ONCE // largest))
    hangs = root != np.arange(len(codes))
    return codes[hangs], codes[root[hangs]]


def links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that join the distinct codes `fp` as all links of at most max_bits would."""
    masks = bit_keys(codes.count(), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = codes.select("fp", F.explode(keys).alias("bucket"))
    full = written(rows.groupBy("bucket").count().where("count > 1").select(F.col("bucket").alias("_bucket"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("_blocks")), "buckets")
    rows = rows.join(full, F.col("bucket") == F.col("_bucket"))
    # A large bucket's members are dealt to blocks; each pair of blocks is a group, and so is each block.
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.select("fp", "bucket", "_blocks", own.alias("own"), other.alias("other")).where("_blocks < 3 OR own <> other")
    rows = rows.select("fp", F.expr("CASE WHEN _blocks < 3 THEN xxhash64(bucket) ELSE xxhash64(bucket, least(own, other), greatest(own, other)) END").alias("grp"), F.expr("_blocks < 3 AND other > 0").alias("again")).where("NOT again").drop("again")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_c = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(g: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(g):
                u, v = _group_links(g, c, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_g = np.r_[held_g, batch.column("grp").to_numpy()]
            held_c = np.r_[held_c, batch.column("fp").to_numpy().view(np.uint64)]
            while len(held_g) >= ROWS_AT_ONCE:
                # Whole groups: up to the last start of a group, or to the end of a group that is longer.
                starts = np.flatnonzero(held_g[1:] != held_g[:-1]) + 1
                within = starts[starts <= ROWS_AT_ONCE]
                cut = int(within[-1]) if len(within) else int(starts[0]) if len(starts) else 0
                if not cut:
                    break
                yield from found(held_g[:cut], held_c[:cut])
                held_g, held_c = held_g[cut:], held_c[cut:]
        yield from found(held_g, held_c)

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the least of its component, with the least. Alternates large and small stars."""
    spark, seen = edges.sparkSession, None
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")
        before, large = now, written(both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        discard(before)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        rest = large.join(least, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(rest.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "small_star")
        discard(large)


def grouped(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = written(fingerprints(docs, shingle_words), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "codes")
    stars = components(links(codes.select("fp"), max_bits))
    tops = stars.select("v").distinct().select(F.col("v").alias("u"), "v")
    member = stars.unionByName(tops).select(F.col("u").alias("_u"), F.col("v").alias("label"))
    member = codes.join(member, F.col("fp") == F.col("_u"), "left").where("n > 1 OR label IS NOT NULL")
    member = written(member.select("fp", "first", F.coalesce("label", "fp").alias("label")), "members")
    name = member.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_label")
    named = written(member.join(name, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), "component_id"), "named")
    joined = rows.join(named, F.col("fp") == F.col("_fp"), "left")
    alone = F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), alone.alias("component_id"))


def kept_documents(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the smallest doc_id's, with the input's columns."""
    stay = grouped(docs, shingle_words, max_bits).where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
