"""The Merkle manifest against a plain tree built level by level."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from veracol.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hexed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars) -> str:
    return hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[str]], list[list[tuple[int, list[str]]]]]:
    """Root, and each leaf's (place, run) by level."""
    steps = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for r, run in enumerate(runs):
            for place in range(len(run)):
                for leaf in under[r * fanout + place]:
                    steps[leaf].append((place, run))
        under = [sum(under[i : i + fanout], []) for i in range(0, len(nodes), fanout)]
        nodes = [hexed(*run) for run in runs]
    return nodes[0], steps


def brute(rows, fanout=2):
    none_first = lambda v: (v is not None, "" if v is None else v)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda r: (none_first(r[0])[0], r[0] or 0, leaf_of(*r)))
        subs[g] = climb([leaf_of(*r) for r in groups[g]], fanout)
    root, tops = climb([subs[g][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = subs[g][1][i] + tops[k]
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf_of(*r[:4], r[4] + 1) if hit else leaf_of(*r)
            siblings = []
            for place, run in steps:
                siblings += run[:place] + run[place + 1 :]
                node = hexed(*run[:place], node, *run[place + 1 :])
            out.append((r[0], leaf_of(*r), subs[g][0], root, hexed(*siblings), node, node == root))
    return sorted(out, key=repr)


def some(n: int):
    rows = [(i * 3, f"text {i} é", ("de", "en", "en", None, "fr")[i % 5], None if i % 7 == 0 else f"s{i % 4}", None if i % 11 == 0 else i) for i in range(n)]
    rows += [(3, None, "en", None, 5), (3, "", "en", "s", None), (3, "", "en", "s", None), (None, "no id", "en", "s", 1), (None, "no id, no lang", None, "s", 1), (9, "x" * 300_000, "zz", "s", 2)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 37, 300])
def test_query_against_plain_tree(spark, n):
    rows = some(n)
    # A column that is named like one of the operator's own must not matter.
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("grp", "leaf", "place", "size", "digest", "root")})
    got = sorted((tuple(r) for r in mm.verified(docs).collect()), key=repr)
    assert got == brute(rows)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_many_traversals_and_other_fanouts(spark, fanout, levels):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(130)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.select("doc_id", F.col("lang").alias("grp"), mm.digest({c: F.col(c) for c in mm.FIELDS}).alias("leaf"))
    got = {r.doc_id: r for r in mm.checked(mm.manifest(leaves, fanout=fanout, levels=levels), "leaf").collect()}
    for doc_id, leaf, subroot, root, proof, _, _ in brute(rows, fanout):
        r = got[doc_id]
        assert (r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_digest.hex(), r.folded_root.hex()) == (leaf, subroot, root, proof, root)


def test_tampering_shows_and_only_there(spark):
    rows = [(i, "t", "en", "s", None if i % 5 == 0 else 1) for i in range(200)]
    got = {r.doc_id: r.verified for r in mm.verified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: not (crc32(str(i).encode()) % 7 == 0 and i % 5) for i in range(200)}


def test_empty_table(spark):
    assert mm.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_block_by_hand():
    a, b, c = (bytes([i]) * 32 for i in range(3))
    root, proofs = mm.block_proofs([a, b, c], 2)
    ab, cc = mm.parent([a, b]), mm.parent([c])
    assert root == mm.parent([ab, cc])
    assert proofs == [bytes((0, 2)) + b + bytes((0, 2)) + cc, bytes((1, 2)) + a + bytes((0, 2)) + cc, bytes((0, 1)) + bytes((1, 2)) + ab]
    assert [mm.folded(x, p)[0] for x, p in zip((a, b, c), proofs, strict=True)] == [root] * 3
