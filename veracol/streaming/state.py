"""Streams with state: running risks of documents, and sessions that expire and are taken once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SUMS = "doc_id long, n long, words long, words2 long, excess100 long, redundant long"
RISK_ROWS = "doc_id long, sent_idx int, uniformity_risk double, translationese_risk double, redundancy_risk double"


def running_risks(features: DataFrame) -> DataFrame:
    """Risks after each sentence of a stream of (doc_id, sent_idx, n_tokens, excess100, is_redundant).

    Five exact sums are a document's whole state. Sentences count in the order in which batches bring them,
    by sent_idx within a batch.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(frames)
        rows = rows.iloc[np.argsort(rows["sent_idx"].to_numpy(), kind="stable")]
        tokens = rows["n_tokens"].to_numpy().astype(np.int64)
        each = (np.ones(len(tokens), np.int64), tokens, tokens**2, rows["excess100"].to_numpy().astype(np.int64), rows["is_redundant"].to_numpy().astype(np.int64))
        n, words, words2, excess, redundant = sums = [b + np.cumsum(x) for b, x in zip(before, each, strict=True)]
        spread = np.sqrt((n * words2 - words * words).astype(np.float64)) / n
        uniform = np.where(n > 1, np.clip((11.0 - spread) * 10.0, 0.0, 100.0), 0.0)
        state.update(tuple(int(x[-1]) for x in sums))
        yield pd.DataFrame({"doc_id": key[0], "sent_idx": rows["sent_idx"].to_numpy(), "uniformity_risk": uniform, "translationese_risk": excess / 100.0 / (n * 6) * 100, "redundancy_risk": 100 * redundant / n})

    state = SUMS.removeprefix("doc_id long, ")
    return features.groupBy("doc_id").applyInPandasWithState(update, RISK_ROWS, state, "append", GroupStateTimeout.NoTimeout)


SESSION_ROWS = "session_id string, seq long, value string"


def sessions(requests: DataFrame, idle_ms: int) -> DataFrame:
    """Answers to reads of a stream of (session_id, seq, op, value).

    `put` stores a value, `get` reads it and makes it young again, `take` reads it once and forgets it; a
    session without requests for idle_ms is forgotten. A read of a forgotten session gives null.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            if r.op == "put":
                value = r.value
            else:
                out.append((key[0], r.seq, value))
                value = None if r.op == "take" else value
        if value is not None:
            state.update((value,))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "seq", "value"])

    return requests.groupBy("session_id").applyInPandasWithState(update, SESSION_ROWS, "value string", "append", GroupStateTimeout.ProcessingTimeTimeout)
