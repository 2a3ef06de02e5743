"""Chat formatting by token-level assembly.

Each turn's role and text are escaped and encoded by themselves; reserved ids, which no text can produce,
are spliced between them; the loss mask is the prefix sum of +1 where an assistant text begins and -1 where
it ends. The text form puts a control string in place of each reserved id.

A turn is  <s>? [ROLE] role [INST] text [/INST]  or, for an assistant,  [ROLE] role [ANSWER] text </s>;
<s> opens the first turn of a conversation. Where a text holds a control string, a backslash is put after
its first character, and backslashes of the text are doubled, so that unescaping restores every text.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; turns are
ordered by turn (null first), then role and text, so that ties and repeated rows have one order; texts of
any length are encoded whole; an empty table gives an empty result; only conv_id, turn, role and text are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracol.llm.byte_bpe import codec

#: Control strings, in the order of their reserved ids, the first of which follows the vocabulary's last.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[INST]", "[/INST]", "[ANSWER]")
FIRST_RESERVED = 50256
_IDS = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROLS)}
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def assembled(role: str, text: str, first: bool, encode) -> tuple[np.ndarray, np.ndarray, str]:
    """ids, loss mask and text form of a turn. encode: texts to ids as little-endian 32-bit integers."""
    role_text, body = escape(role), escape(text)
    answer = role == ASSISTANT
    opening, closing = ("[ANSWER]", "</s>") if answer else ("[INST]", "[/INST]")
    role_ids, body_ids = (np.frombuffer(x, "<u4").astype(np.int32) for x in encode([role_text, body]))
    head = [_IDS["<s>"]] * first + [_IDS["[ROLE]"]]
    ids = np.concatenate([head, role_ids, [_IDS[opening]], body_ids, [_IDS[closing]]]).astype(np.int32)
    steps = np.zeros(len(ids) + 1, np.int32)
    if answer:
        begin = len(head) + len(role_ids) + 1
        steps[begin] += 1
        steps[begin + len(body_ids)] -= 1
    return ids, np.cumsum(steps)[:-1].astype(np.int32), "<s>" * first + "[ROLE]" + role_text + opening + body + closing


def formatted(turns: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row per turn: conv_id, turn, position fields, ids, loss_mask, formatted.

    A conversation is the concatenation of its rows in order; none is gathered in one place here, so a
    conversation of any length is formatted turn by turn.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    least = rows.groupBy("conv_id").agg(F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("_least"))
    # The first turn opens the conversation; among ties only the least in order does, which one row number over the tied rows finds.
    lead = rows.join(least.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    at_least = F.coalesce("turn", F.lit(-(1 << 63))) == F.col("_least")
    tied = lead.where(at_least).withColumn("first", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) == 1)
    rows = tied.unionByName(lead.where(~at_least).withColumn("first", F.lit(False))).select("conv_id", "turn", "role", "text", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            made = [assembled(r, t, f, own.encode) for r, t, f in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "first")), strict=True)]
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            columns += [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "ids", "loss_mask", "formatted"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<int>, formatted string")


class _Reader:
    """Reads a conversation back from its ids, turn by turn, keeping digests but no text."""

    def __init__(self) -> None:
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: np.ndarray, mask: np.ndarray, text: str, decode) -> None:
        reserved = np.flatnonzero(ids >= FIRST_RESERVED)
        role_at, body_at, end_at = reserved[-3:]
        role, body = (unescape(decode(ids[a + 1 : b].astype("<u4").tobytes()).decode()) for a, b in ((role_at, body_at), (body_at, end_at)))
        self.turns += 1
        self.all.update(f"{role}\n{body}\n".encode())
        learnt = unescape(decode(ids[mask == 1].astype("<u4").tobytes()).decode())
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per conversation, what its formatted rows hold: counts and digests, from the ids and the mask alone.

    Rows stream by in order and only running digests are kept, however long a conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current, reader, done = codec(rank_path, pattern), None, None, []

        def flush() -> pa.RecordBatch:
            names = [f.split(" ")[0] for f in READ_BACK.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, masks = ([x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(c)] for c in ("ids", "loss_mask"))
            for conv, i, m, text in zip(batch.column("conv_id").to_pylist(), ids, masks, batch.column("formatted").to_pylist(), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append((current, *reader.row()))
                    current, reader = conv, _Reader()
                reader.take(i, m, text, own.decode)
            if done:
                yield flush()
                done = []
        if reader is not None:
            done.append((current, *reader.row()))
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(run, READ_BACK)
