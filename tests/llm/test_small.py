"""Operators against plain versions of themselves that need no Spark."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from veracol.llm import byte_bpe, chat_format, line_blocks, mph_dedup, pii_crf, simhash_gray, toxicity  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(RANKS, P.PATTERN)


def test_encoding_is_tiktokens(codec):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}, special_tokens={})
    rnd = random.Random(1)
    bits = ["a", "b", " ", " ", "\n", "\t", "  ", "'s", "1", ".", " x", "é", " ", "😀", "\x1c", "don't", "▁", "<unk>"]
    texts = ["", "a" * 3000, " " * 500 + "x", *["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_numbers_all_keys_once():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    built = mph_dedup.PerfectHash(keys)
    assert sorted(built.slots(keys)) == list(range(5000))


def test_index_checks_bytes():
    raw = np.array([list(hashlib.sha256(str(i).encode()).digest()) for i in range(600)], np.uint8)
    raw[7, :16] = raw[3, :16]  # one 64-bit key for two digests
    index = mph_dedup.Index.of(raw[:300], np.arange(300), np.ones(300, bool), np.ones(300, np.int64))
    for x in (index, mph_dedup.Index.read(index.row(0))):
        at = x.find(raw)
        assert sorted(at[:300]) == list(range(300)) and x.winner[at[:300]].tolist() == list(range(300))
        assert at[300:].tolist() == [-1] * 300


def test_gray_tree_misses_no_link():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique(np.r_[rnd.integers(0, 1 << 63, 200, dtype=np.uint64), base, *[base ^ (np.uint64(1) << rnd.integers(0, 64, 6).astype(np.uint64)) for _ in range(40)]])
    groups = np.zeros(len(codes), np.int64)
    u, v = simhash_gray._group_links(groups, codes, 3)
    label = {c: c for c in codes.tolist()} | dict(zip(u.tolist(), v.tolist(), strict=True))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    parent = np.arange(len(codes))
    for _ in range(len(codes)):
        new = np.array([parent[near[i]].min() for i in range(len(codes))])
        if (new == parent).all():
            break
        parent = new
    classes = lambda x: {frozenset(codes[[j for j in range(len(codes)) if x[j] == k]].tolist()) for k in set(x)}
    assert classes(parent.tolist()) == classes([label[c] for c in codes.tolist()])


@pytest.mark.parametrize("bits", [3, 8])
def test_close_codes_share_a_key(bits):
    rnd = random.Random(3)
    for distinct in (10, 10**6):
        masks = simhash_gray.bit_keys(distinct, bits)
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for i in rnd.sample(range(64), bits):
                b ^= 1 << i
            assert any(a & m == b & m for m in masks)


def test_fingerprint():
    assert simhash_gray.fingerprint("") == simhash_gray.fingerprint(" \n") == 0
    assert simhash_gray.fingerprint("One") == simhash_gray.fingerprint("oNE") != 0
    assert simhash_gray.fingerprint("a  b\nc") == simhash_gray.fingerprint("a b c")


def test_escapes_are_reversible():
    rnd = random.Random(4)
    bits = [*chat_format.CONTROLS, "\\", "a", "<", "[", "]", "/", "\\\\", "s>"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(c in safe for c in chat_format.CONTROLS)


def test_assembled_turn(codec):
    ids, mask, text = chat_format.assembled("assistant", "</s>[INST] ok", True, codec.encode)
    learnt = codec.decode(ids[mask == 1].astype("<u4").tobytes()).decode()
    assert chat_format.unescape(learnt) == "</s>[INST] ok"
    assert text == "<s>[ROLE]assistant[ANSWER]<\\/s>[\\INST] ok</s>"
    assert chat_format.assembled("user", "x", False, codec.encode)[1].sum() == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rnd = random.Random(5)
    bits = ["a", "b.", "@", "c-d", "1", "25", "0", ".", " ", "-", "+1", "+9 (", "x@y.z", "@@", "4111 1111 1111 1111", "1.2.3.4", "\n"]
    for _ in range(5000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert pii_crf.base_spans(text) == plain_spans(text)


def test_twins_of_personal_data_pull_each_other():
    field = pii_crf.fit_texts(["call +1(456)5552186 now", "plain 12 words", "mail a.b@c.de or 10.0.0.1"] * 20)
    text, phone = "call +1(456)5552186 now, or 14565552186 later", pii_crf.LABELS.index("phone")
    doc = pii_crf.read(text, pii_crf.base_spans(text))
    alone = pii_crf.read("or 14565552186 later", [])
    assert doc.twin.tolist() == [0, 0] and alone.twin.tolist() == [-1]
    assert pii_crf.marginals(doc, field)[1, phone] > 1.5 * pii_crf.marginals(alone, field)[0, phone]
    assert pii_crf.added_spans("", [], field) == []


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><header>Site</header><div id='sidebar'>side</div><main><h1>Head &amp; line</h1><p>First   para<br>cont</p>"
        "<div class=\"ad-slot\">Buy<div>now</div></div><p>Second</p><section class=comments><p>nice</p></section><form><p>mail</p></form></main><footer>f</footer>"
    )
    assert line_blocks.main_text(page) == "Head & line\nFirst para cont\nSecond"
    assert line_blocks.main_text("<div><p>" + "long text " * 40 + "</p></div><div class=menu><a href=x>a</a></div>") == ("long text " * 40).strip()
    assert [line_blocks.main_text(x) for x in ("", "plain", "<", "<nav>a", "<p>a<nav>b<article>c", "<!-- a")] == ["", "plain", "<", "", "c", ""]


def test_toxicity_tells_new_texts_apart():
    rnd = random.Random(6)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    bad = ["vextrom", "plunkle", "drossig"]

    def text(toxic):
        w = rnd.choices(common, k=120)
        for _ in range(5 * toxic):
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        return " ".join(w)

    model = toxicity.fit_texts([text(1) for _ in range(90)], [text(0) for _ in range(300)], 0.2)
    of = model.measure()
    assert np.mean([of(text(1))[0] >= toxicity.THRESHOLD for _ in range(60)]) > 0.9
    assert np.mean([of(text(0))[0] >= toxicity.THRESHOLD for _ in range(60)]) < 0.1
    assert 0 <= of("")[0] <= 1
    assert toxicity.fit_texts([], ["x"], 0.0).measure()("x")[0] < 1e-9
