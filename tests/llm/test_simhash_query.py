"""The whole SimHash query against all pairs: chains of links, buckets of many blocks, ties, nulls, equal texts."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")
from veracol.llm import simhash_gray  # noqa: E402


def plain_fingerprint(text: str) -> int:
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("block_rows", [8192, 4])
def test_whole_query_against_all_pairs(spark, monkeypatch, block_rows):
    rnd = random.Random(12)
    rows = [(900, None), (901, ""), (902, " \n"), (None, "x y"), (None, "x y"), (903, "X Y")]
    for g in range(4):
        words = [f"w{rnd.randrange(3000)}" for _ in range(400)]
        for i in range(30):
            rows.append((g * 100 + i, " ".join(words)))
            words = list(words)
            words[rnd.randrange(400)] = f"y{rnd.randrange(3000)}"  # each a step from the one before
    rows += [(400 + i, " ".join(f"z{rnd.randrange(9000)}" for _ in range(60))) for i in range(40)]
    rnd.shuffle(rows)
    codes = [plain_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], f"{codes[i]:016x}", least[root[i]]) for i in range(len(rows))), key=repr)
    assert len(set(root)) < len(rows) - 60  # long chains are there
    monkeypatch.setattr(simhash_gray, "BLOCK_ROWS", block_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash_gray.grouped(docs).collect()), key=repr) == want
