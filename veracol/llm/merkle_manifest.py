"""A Merkle manifest of a dataset: every row's digest, and its proof up to one root.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 length, `:` and its value. Leaves are
numbered within their group by a range sort, cut into aligned blocks, and each block is traversed in postorder: a
call returns its subtree's digest and, while it unwinds, appends the digests of the siblings to the leaves that the
subtree holds. Block roots are the leaves of the next traversal, until one is left of each group; these subroots,
ordered by group, are the leaves of a last tree. A path is read back through the levels by joins on block numbers.
No task sees more than a block, and nothing but the size of the largest group reaches the driver.

Defined cases: null fields are `-`; rows of a null group are a group of its own, first in order; null ids come first;
rows of one id (repeated rows too) ascend by leaf and each has its own proof; an only leaf is its group's subroot;
an empty table gives no rows; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.llm.common import discard, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that make one parent, and the levels that one traversal climbs (1,024 leaves a block).
FANOUT = 2
LEVELS = 10


def digest(values: dict[str, Column]) -> Column:
    """The SHA-256 of the fields in order, as 32 bytes."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def _numbered(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int, list[DataFrame]]:
    """Nodes with their place in their group (from 0) and its size; the largest size; the tables to discard after.

    Rows are range-sorted and stored with their place in their part; one row a part and group carries the offsets.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = written(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle_order")
    parts = placed.groupBy("grp", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(parts.select(F.col("grp").alias("grp_"), F.col("part").alias("part_"), (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "merkle_offsets")
    largest = offsets.agg(F.max("size")).first()[0] or 0
    same = F.col("grp").eqNullSafe(F.col("grp_")) & (F.shiftright("at", 33) == F.col("part_"))
    return placed.join(offsets, same).withColumn("place", F.col("at") + F.col("shift")).drop("grp_", "part_", "shift", "at"), largest, [placed, offsets]


def block_proofs(digests: Sequence[bytes], levels: int, fanout: int = FANOUT) -> tuple[bytes, list[bytes]]:
    """The digest of an aligned block's subtree of so many levels, and each leaf's proof within it.

    A proof is, level by level, a byte with the place in the run, one with the run's length, and the siblings' digests.
    """
    proofs: list[list[bytes]] = [[] for _ in digests]

    def climb(start: int, level: int) -> bytes:
        if level == 0:
            return digests[start]
        width = fanout ** (level - 1)
        starts = range(start, min(start + width * fanout, len(digests)), width)
        run = [climb(s, level - 1) for s in starts]
        for i, s in enumerate(starts):
            step = bytes((i, len(run))) + b"".join(run[:i] + run[i + 1 :])
            for proof in proofs[s : s + width]:
                proof.append(step)
        return parent(run)

    return climb(0, levels), [b"".join(p) for p in proofs]


def parent(run: Sequence[bytes]) -> bytes:
    """Digests count as hexadecimal text."""
    return sha256(b"".join(run).hex().encode()).digest()


def _height(n: int, fanout: int, most: int) -> int:
    height, held = 0, 1
    while held < n and height < most:
        height, held = height + 1, held * fanout
    return height


def _climbed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One traversal of nodes (grp, place, size, digest and others): adds block, proof, and root at each block's first node."""
    block = fanout**levels
    kept = nodes.schema.fields
    names = [f.name for f in kept]

    def climb(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        root, proofs = block_proofs(rows.column("digest").to_pylist(), _height(rows.column("size")[0].as_py(), fanout, levels), fanout)
        out = rows.select([*names, "block"])
        return out.append_column("proof", pa.array(proofs, pa.binary())).append_column("root", pa.array([root] + [None] * (len(proofs) - 1), pa.binary()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return nodes.withColumn("block", F.expr(f"place div {block}")).groupBy("grp", "block").applyInArrow(climb, f"{schema}, block long, proof binary, root binary")


def _tree(nodes: DataFrame, order: Sequence[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes (grp, digest, others) with their block and proof in it; per block the path from there up and the group's
    root (grp, block, path, top); the tables to discard after."""
    placed, largest, used = _numbered(nodes, order)
    climbed = [written(_climbed(placed, fanout, levels), "merkle_level")]
    while True:
        roots = climbed[-1].where("root IS NOT NULL").select("grp", F.col("block").alias("place"), F.expr(f"(size - 1) div {fanout**levels} + 1").alias("size"), F.col("root").alias("digest"))
        largest = -(-largest // fanout**levels)
        if largest <= 1:
            break
        climbed.append(written(_climbed(roots, fanout, levels), "merkle_level"))
    paths = roots.select("grp", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.col("digest").alias("top"))
    for level in reversed(climbed[1:]):
        paths = _joined(level.select("grp", "place", "block", "proof"), paths).select("grp", F.col("place").alias("block"), F.concat("proof", "path").alias("path"), "top")
    return climbed[0], paths, used + climbed[1:]


def _joined(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    above = paths.select(F.col("grp").alias("grp_"), F.col("block").alias("block_"), "path", "top")
    return nodes.join(above, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("block") == F.col("block_"))).drop("grp_", "block_")


def manifest(leaves: DataFrame, order: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The proof of each row of `leaves`, which has a group `grp`, the column to order by, its digest `leaf`, and others.

    Adds proof (the siblings up to the root, see `block_proofs`), subroot (the group's) and root.
    """
    nodes = written(leaves.withColumn("digest", F.col("leaf")), "merkle_leaves")
    first, paths, used = _tree(nodes, [order, "leaf"], fanout, levels)
    groups = paths.where("block = 0").select(F.col("grp").alias("name"), "top")
    groups = written(groups.select(F.lit(0).alias("grp"), "name", F.col("top").alias("digest")), "merkle_subroots")
    last, up, above = _tree(groups, ["name"], fanout, levels)
    tops = _joined(last.select("grp", "name", "block", "digest", "proof"), up).select(F.col("name").alias("name_"), F.concat("proof", "path").alias("rest"), F.col("digest").alias("subroot"), F.col("top").alias("root"))
    paths = paths.join(tops, F.col("grp").eqNullSafe(F.col("name_"))).select("grp", "block", F.concat("path", "rest").alias("path"), F.struct("subroot", "root").alias("top"))
    paths = written(paths, "merkle_paths")
    out = _joined(first, paths).select(*leaves.columns, F.concat("proof", "path").alias("proof"), "top.subroot", "top.root")
    discard(nodes, groups, last, *used, *above)
    return out


def folded(leaf: bytes, proof: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its proof lead to, and the digest of the proof's siblings."""
    at, siblings = 0, []
    while at < len(proof):
        place, run = proof[at], proof[at + 1]
        end = at + 2 + 32 * (run - 1)
        others = [proof[i : i + 32] for i in range(at + 2, end, 32)]
        siblings += others
        leaf = parent([*others[:place], leaf, *others[place:]])
        at = end
    return leaf, parent(siblings)


def checked(rows: DataFrame, claimed: str = "claimed") -> DataFrame:
    """Adds to a manifest's rows folded_root, from the claimed leaf and the row's proof, and proof_digest."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [folded(*x) for x in zip(batch.column(claimed).to_pylist(), batch.column("proof").to_pylist(), strict=True)]
            columns = [*batch.columns, *[pa.array([b[i] for b in both], pa.binary()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "folded_root", "proof_digest"])

    return rows.mapInArrow(run, f"{schema}, folded_root binary, proof_digest binary")


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root and digest of its proof, and whether its leaf, tampered with where 7 divides the
    id's CRC-32 (1 added to n_chars), still leads to the root."""
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    hit = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 7 == 0
    more = (columns["n_chars"].cast("decimal(20,0)") + 1).cast("string")
    leaves = docs.select(columns["doc_id"], columns["lang"].cast("string").alias("grp"), digest(columns).alias("leaf"), F.when(hit, digest(columns | {"n_chars": more})).alias("claimed"))
    rows = checked(manifest(leaves).withColumn("claimed", F.coalesce("claimed", "leaf")))
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")}
    return rows.select("doc_id", text["leaf"], text["subroot"], text["root"], F.lower(F.hex("proof_digest")).alias("proof_sha256"), text["folded_root"], (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text in SQL, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {byte}), 4294967295)"


def oracle() -> str:
    def leaf(**other: str) -> str:
        values = [other.get(c, c) for c in FIELDS]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + "))"

    def tree(name: str, nodes: str) -> str:
        return (
            f"{name} AS (SELECT 0 AS lvl, grp, i, n, h FROM {nodes} UNION ALL "
            f"SELECT lvl + 1, grp, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, grp, i // 2)"
        )

    return f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, lang AS grp, {leaf()} AS h, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf(n_chars="(n_chars + 1)")} ELSE {leaf()} END AS claimed FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM raw),
{tree("low", "placed")},
subroots AS (SELECT grp AS name, h FROM low WHERE n = 1),
named AS (SELECT name, 0 AS grp, h, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots),
{tree("high", "named")},
root AS (SELECT h AS root FROM high WHERE n = 1),
steps AS (
  SELECT p.rid, 0 AS part, l.lvl, (p.i >> l.lvl) & 1 AS side, s.h FROM placed p JOIN low l ON l.grp IS NOT DISTINCT FROM p.grp AND l.i = p.i >> l.lvl AND l.n > 1
    LEFT JOIN low s ON s.grp IS NOT DISTINCT FROM p.grp AND s.lvl = l.lvl AND s.i = xor(l.i, 1)
  UNION ALL
  SELECT p.rid, 1, l.lvl, (m.i >> l.lvl) & 1, s.h FROM placed p JOIN named m ON m.name IS NOT DISTINCT FROM p.grp JOIN high l ON l.i = m.i >> l.lvl AND l.n > 1
    LEFT JOIN high s ON s.lvl = l.lvl AND s.i = xor(l.i, 1)),
proofs AS (SELECT rid, list({{'side': side, 'h': h}} ORDER BY part, lvl) AS steps, coalesce(string_agg(h, '' ORDER BY part, lvl), '') AS siblings FROM steps GROUP BY rid),
ready AS (SELECT p.rid, p.doc_id, p.grp, p.h AS leaf, p.claimed, coalesce(f.steps, []) AS steps, coalesce(f.siblings, '') AS siblings FROM placed p LEFT JOIN proofs f USING (rid)),
folded AS (
  SELECT rid, 1 AS k, claimed AS h FROM ready UNION ALL
  SELECT rid, k + 1, sha256(CASE WHEN r.steps[k].h IS NULL THEN f.h WHEN r.steps[k].side = 0 THEN f.h || r.steps[k].h ELSE r.steps[k].h || f.h END)
  FROM folded f JOIN ready r USING (rid) WHERE k <= len(r.steps)),
ends AS (SELECT rid, max_by(h, k) AS folded_root FROM folded GROUP BY rid)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ready r JOIN ends USING (rid) JOIN subroots s ON s.name IS NOT DISTINCT FROM r.grp CROSS JOIN root
"""
