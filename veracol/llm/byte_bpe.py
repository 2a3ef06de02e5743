"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from a rank file.

The model is written, not trained: piece number r is the token of rank r with every byte mapped to one
printable character, its score is -r, the model type is BPE and the normaliser is the identity. Merging the
adjacent pair with the best score is then merging the pair with the lowest rank. Text is split into
pre-tokens first, each is encoded by itself, and decoding maps piece characters back to bytes.

Defined cases: null or empty text has no tokens and decodes to no bytes; a text of any length is encoded
whole, one text at a time; repeated rows are encoded again; an empty table gives an empty result; only the
columns named by the caller are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Distinct pre-tokens that a worker remembers before it starts afresh (bounds its memory).
CACHE_ENTRIES = 300_000
#: Longer pre-tokens are encoded but not remembered.
CACHE_CHARS = 64
#: A space before each character of the property White_Space.
SPACE_PAIRS = [" " + chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Texts whose unknown pre-tokens are encoded in one call.
TEXTS_PER_CALL = 32


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it has one, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes are length-delimited, ints varints, floats 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"ranks in {path} aren't consecutive")
    return [tokens[r] for r in range(len(tokens))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a ranked vocabulary; the unknown piece comes last."""
    chars, normal, unknown, bpe = byte_characters(), 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes texts to ids and back; one per worker process."""

    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(rank_path)
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self._split = regex.compile(pattern).findall
        chars = byte_characters()
        self._map = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self._bytes = [bytes(back[c] for c in self._pieces.id_to_piece(i)) for i in range(len(tokens))]
        self._space = chars[0x20]
        self._pack = [struct.Struct(f"<{n}I").pack for n in range(65)]
        alone = self._pieces.encode(["".join(chars[b] for b in t) for t in tokens], num_threads=1)
        self._unmerged = {t: struct.pack("<I", r) for r, (t, ids) in enumerate(zip(tokens, alone, strict=True)) if ids != [r]}
        self._known: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def _mapped(self, word: str) -> str:
        """One printable character for each byte."""
        return word.replace(" ", self._space) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._map)

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        found = [self._pack[len(ids)](*ids) if len(ids) <= 64 else array("I", ids).tobytes() for ids in self._pieces.encode([self._mapped(w) for w in words], num_threads=1)]
        if self._unmerged:
            found = [self._unmerged.get(w.encode(), ids) for w, ids in zip(words, found, strict=True)]
        return found

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of texts, by the pattern."""
        split = [self._split(x) for x in runs]
        if len(self._known) > CACHE_ENTRIES:
            self._known = {}
        known = self._known
        words = list(set().union(*split).difference(known))
        new = dict(zip(words, self._learn(words), strict=True))
        if any(len(w) > CACHE_CHARS for w in words):
            known.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_CHARS)
            return [b"".join([known[w] if w in known else new[w] for w in x]) for x in split]
        known.update(new)
        return [b"".join(map(known.__getitem__, x)) for x in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit integers.

        Where no space meets other white space, no match of the pattern crosses the start of a space, so that a
        text is the sequence of its pieces " x"; those are looked up whole, and one of letters alone is a
        single match. Other texts go by the pattern alone.
        """
        plain = [not any(pair in t for pair in SPACE_PAIRS) for t in texts]
        pieces = [t.split(" ") if ok else () for t, ok in zip(texts, plain, strict=True)]
        if len(self._chunks) > CACHE_ENTRIES:
            self._chunks = {}
        chunks = self._chunks
        missing = set().union(*[x[1:] for x in pieces]).difference(chunks)
        letters = [c for c in missing if c.isalpha() and len(c) <= CACHE_CHARS]
        chunks.update(zip(letters, self._learn([" " + c for c in letters]), strict=True))
        others = list(missing.difference(letters))
        whole = [x[0] if ok else t for t, x, ok in zip(texts, pieces, plain, strict=True)]
        ids = self._encode_runs([*whole, *[" " + c for c in others]])
        new = dict(zip(others, ids[len(whole) :], strict=True))
        if any(len(c) > CACHE_CHARS for c in others):
            chunks.update((c, i) for c, i in new.items() if len(c) <= CACHE_CHARS)
            return [first + b"".join([chunks[c] if c in chunks else new[c] for c in x[1:]]) for first, x in zip(ids, pieces, strict=False)]
        chunks.update(new)
        return [first + b"".join(map(chunks.__getitem__, x[1:])) for first, x in zip(ids, pieces, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_path: str, pattern: str) -> Codec:
    """This process's codec for a vocabulary."""
    if (rank_path, pattern) not in _codecs:
        _codecs[rank_path, pattern] = Codec(rank_path, pattern)
    return _codecs[rank_path, pattern]


def _lists(ids: list[bytes]) -> pa.Array:
    sizes = array("i", [0])
    for x in ids:
        sizes.append(sizes[-1] + len(x) // 4)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(ids))]))


def encoded_batches(batches: Iterator[pa.RecordBatch], rank_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds `ids` to batches that have `text`, a few texts at a time."""
    own = codec(rank_path, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_PER_CALL):
            part = batch.slice(start, TEXTS_PER_CALL)
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield part.append_column("ids", _lists(own.encode(texts)))


def decoded_batches(batches: Iterator[pa.RecordBatch], rank_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds `decoded`, the bytes of each row's `ids`."""
    own = codec(rank_path, pattern)
    for batch in batches:
        lists = batch.column("ids")
        values, ends = lists.values, lists.offsets.to_numpy()
        raw = memoryview(values.buffers()[1]).cast("B") if len(values) else memoryview(b"")
        at = values.offset
        out = [own.decode(raw[4 * (at + a) : 4 * (at + b)]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield batch.append_column("decoded", pa.array(out, pa.binary()))


def encoded(docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and each whole text's `ids`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"))
    schema = rows.drop("text").schema.add("ids", ArrayType(IntegerType()))
    out = rows.mapInArrow(lambda b: (x.drop_columns(["text"]) for x in encoded_batches(b, rank_path, pattern)), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "ids")


def decoded(ids: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The decoded bytes of each row's `ids`, beside its other columns."""
    others = [c for c in ids.columns if c != "ids"]
    rows = ids.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    schema = StructType([*rows.schema.fields, StructField("decoded", BinaryType())])
    out = rows.mapInArrow(lambda b: decoded_batches(b, rank_path, pattern), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "ids", "decoded")


def round_trips(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded in one pass."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in decoded_batches(encoded_batches(batches, rank_path, pattern), rank_path, pattern):
            lists = x.column("ids")
            values, ends = lists.values, lists.offsets.to_numpy()
            raw = memoryview(values.buffers()[1]).cast("B") if len(values) else memoryview(b"")
            shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            plain = [hashlib.sha256(d).hexdigest() for d in x.column("decoded").to_pylist()]
            counts = pc.cast(pc.list_value_length(lists), pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), counts, pa.array(shas), pa.array(plain)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(digests, schema)
