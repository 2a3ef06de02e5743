"""One document of each group of near copies: 5-word shingle sets of a Jaccard similarity of 0.8 or more.

Candidates come from the Gray-order index over SimHash fingerprints of five-word shingles. Its radius, at which
an index can prune, doesn't reach every pair at the asked similarity (at 0.8 fingerprints differ by 10 of 64
bits on average), so bands of minimum hashes add those beyond it: a pair at the similarity itself fails to
meet with probability (1 - 0.8^5)^32, 3 in a million, and less above. Candidates that hang together are
gathered, and within them every pair that isn't joined yet is compared by its whole shingle sets. Only confirmed
pairs are links.

A large group is dealt to blocks twice, by two hashes, and compared block by block. What isn't joined to the
group's largest class by then is compared with all of it, the members of that class with one another no more;
so a group whose members are all alike costs as much as it is long.

Defined cases: words are lower case; fewer words than a shingle make one shingle; null or empty text, or white
space alone, has no shingles and equals only such text; rows are told apart by a number of their own, so that
null or shared ids never merge them; the smallest doc_id of a group stays (null last); an empty table gives an
empty result; all columns are carried in one struct, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracol.llm.common import written
from veracol.llm.simhash_gray import MAX_BITS, components, links, majority, shingle_hashes

SHINGLE_WORDS = 5
SEED = 42
#: Bands, and minimum hashes in each.
BANDS, BAND_ROWS = 32, 5
#: Rows and characters of a group of candidates above which it is compared in blocks.
BLOCK_ROWS, BLOCK_CHARS = 1024, 8_000_000

_rnd = np.random.default_rng(SEED)
_TIMES = _rnd.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _rnd.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band's minimum hashes."""
    import xxhash

    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512, None] * _TIMES + _PLUS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def confirmed(sets: list[np.ndarray], joined: list[int] | None = None) -> np.ndarray:
    """The least place that each set hangs together with by links of similarity 0.8 or more.

    joined: a number of each set's class, where some are known to hang together.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.arange(n)
    if joined is not None:
        _, first, inverse = np.unique(joined, return_index=True, return_inverse=True)
        root = first[inverse]
    flat, ends = np.concatenate(sets), np.r_[0, np.cumsum(size)]
    for i in range(n - 1):
        left = root != root[i]
        left[:i] = False
        left &= 5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])
        if not left.any():
            continue
        if size[i]:
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            shared = np.diff(np.r_[0, np.cumsum(sets[i][at] == flat)][ends])
        else:
            shared = np.zeros(n, np.int64)
        # shared / (size + size[i] - shared) >= 4 / 5
        met = left & (9 * shared >= 4 * (size + size[i]))
        if met.any():
            labels = np.unique(np.r_[root[i], root[met]])
            root[np.isin(root, labels)] = labels[0]
    return root


def _numbered(docs: DataFrame) -> DataFrame:
    """node (a row's own number), row (the input's columns), bands, fp; written once, so that numbers stay."""
    place = docs.columns.index("text")
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, codes = [], []
            for t in pc.struct_field(batch.column("row"), [place]):
                hashes = shingle_hashes(t.as_py() or "", SHINGLE_WORDS)
                keys.append(bands(np.unique(hashes)))
                codes.append(majority(hashes))
            fp = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64())), fp], names=["node", "row", "bands", "fp"])

    schema = T.StructType([*rows.schema.fields, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    return written(rows.mapInArrow(run, schema), "near_rows")


def _members(edges: DataFrame) -> DataFrame:
    """_node, label of every row that hangs together with another."""
    stars = components(edges)
    tops = stars.select("v").distinct().select(F.col("v").alias("u"), "v")
    return written(stars.unionByName(tops).select(F.col("u").alias("_node"), F.col("v").alias("label")), "near_members")


def _candidates(rows: DataFrame) -> DataFrame:
    """Edges that join the rows which the Gray index or a band brings together."""
    codes = written(rows.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")), "near_codes")
    name = codes.select(F.col("fp").alias("_fp"), "lead")
    equal = rows.select("node", "fp").join(name.where(codes.n > 1), F.col("fp") == F.col("_fp")).where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    near = written(links(codes.select("fp"), MAX_BITS), "near_links")
    near = near.join(name, F.col("u") == F.col("_fp")).select(F.col("lead").alias("_u"), "v").join(name, F.col("v") == F.col("_fp")).select(F.col("_u").alias("u"), F.col("lead").alias("v"))
    keys = rows.select("node", F.explode("bands").alias("band"))
    full = keys.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("_band"), "v")
    full = written(full, "near_bands")
    met = keys.join(full, F.col("band") == F.col("_band")).where("node <> v").select(F.col("node").alias("u"), "v")
    return met.unionByName(equal).unionByName(near).distinct()


def _compared(found: DataFrame) -> DataFrame:
    """Links (u, v) within each group. found: label, kind, low, high (which name the group), node, class, text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, classes, sets = None, [], [], []

        def met() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                root = confirmed(sets, classes)
                at = np.flatnonzero(root != np.arange(len(root)))
                numbers = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(numbers[root[at]])], names=["u", "v"])

        for batch in batches:
            for label, kind, low, high, node, one, text in zip(*batch.columns, strict=True):
                now = label.as_py(), kind.as_py(), low.as_py(), high.as_py()
                if now != group:
                    yield from met()
                    group, nodes, classes, sets = now, [], [], []
                nodes.append(node.as_py())
                classes.append(one.as_py())
                sets.append(np.unique(shingle_hashes(text.as_py(), SHINGLE_WORDS)))
        yield from met()

    by = ("label", "kind", "low", "high")
    rows = found.select(*by, "node", "class", "text")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(search, "u long, v long")


def _block(blocks: str, salt: int = 7) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks)).cast("int")


def _blocks_of(rows: Column, chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(chars / BLOCK_CHARS)).cast("int")


def _confirmed_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (u, v) that join the candidates as all links of the asked similarity would."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    found = rows.join(members, F.col("node") == F.col("_node")).select("node", "label", text.alias("text"))
    found = written(found, "near_texts")
    zero, size = F.lit(0), F.length("text").cast("long")
    large = found.groupBy("label").agg(_blocks_of(F.count(F.lit(1)), F.sum(size)).alias("_blocks")).where("_blocks > 1")
    large = written(large.withColumnRenamed("label", "_label"), "near_blocks")
    at = F.col("label") == F.col("_label")
    small = found.join(large, at, "left_anti")
    first = _compared(small.select("label", zero.alias("kind"), zero.alias("low"), zero.alias("high"), "node", F.col("node").alias("class"), "text"))
    if large.isEmpty():
        return first
    many = found.join(large, at)
    dealt = [many.select("label", F.lit(i).alias("kind"), _block("_blocks", salt).alias("low"), zero.alias("high"), "node", F.col("node").alias("class"), "text") for i, salt in enumerate((7, 11))]
    known = written(_compared(dealt[0].unionByName(dealt[1])), "near_dealt")
    classes = _members(known).select("_node", F.col("label").alias("_class"))
    many = many.drop("_label", "_blocks").join(classes, F.col("node") == F.col("_node"), "left").select("label", "node", F.coalesce("_class", "node").alias("class"), "text")
    many = written(many, "near_classes")
    sizes = many.groupBy("label", "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("label").agg(F.max_by("class", F.struct("n", "class")).alias("_main"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("label").alias("_label"), "_main")
    in_main = F.col("class") == F.col("_main")
    count = lambda own: _blocks_of(F.count(F.when(own, 1)), F.sum(F.when(own, size)))
    plan = many.join(main, at).groupBy("_label", "_main").agg(count(in_main).alias("_b"), count(~in_main).alias("_r"))
    plan = written(plan, "near_plan")
    if plan.isEmpty():
        return first.unionByName(known)
    many = many.join(plan, at).withColumn("_own", F.when(in_main, _block("_b")).otherwise(_block("_r")))
    names = ["label", "node", "class", "text", "_own"]
    bulk, rest = many.where(in_main), many.where(~in_main)
    upto = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    both = rest.select(*names, upto("_r").alias("_other")).withColumn("kind", zero)
    both = both.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other"))
    mixed = rest.select(*names, upto("_b").alias("low")).withColumn("kind", F.lit(1)).withColumn("high", F.col("_own"))
    bulk = bulk.select(*names, upto("_r").alias("high")).withColumn("kind", F.lit(1)).withColumn("low", F.col("_own"))
    columns = ["label", "kind", "low", "high", "node", "class", "text"]
    last = _compared(both.select(*columns).unionByName(mixed.select(*columns)).unionByName(bulk.select(*columns)))
    return first.unionByName(known).unionByName(last)


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the input's columns."""
    rows = _numbered(docs)
    members = _members(_confirmed_links(rows, _members(_candidates(rows))))
    ids = rows.select("node", F.col("row.doc_id").alias("doc_id"))
    ranked = members.join(ids, F.col("_node") == F.col("node")).select("label", F.struct(F.col("doc_id").isNull(), "doc_id", "node").alias("at"))
    stay = ranked.groupBy("label").agg(F.min("at").getField("node").alias("_stay"))
    gone = members.join(stay.select(F.col("label").alias("_label"), "_stay"), F.col("label") == F.col("_label")).where("_node <> _stay").select("_node")
    out = rows.join(gone, F.col("node") == F.col("_node"), "left_anti")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
