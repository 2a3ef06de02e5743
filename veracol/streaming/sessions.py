"""Sessions as keyed state of a stream: values that idle sessions lose, that are taken once, and lookups not asked twice.

A session is a key. Its value is put, read (which makes it young again: a write of its own) and taken (which deletes
it). Lookups are a map beside it: an outcome, found or not, answers the same question until its own time is up, so
that a failed search isn't repeated at once. Times are event times. What is out of date is decided by the times in the
state, so that answers don't depend on where batches end; timers only remove what no row can see any more.

Each call of the state is a trip to the executor and back, so a session has one timer, for when the last of what it then has
is out (what came since sets it anew); a session that is new, or has no lookup that is still good, isn't asked for lookups;
and only what changed is written.

State lives in RocksDB and is restored from the checkpoint. Rows of one key in one batch are sorted in memory, so a
source should bound its batches; rows later than the watermark are dropped by Spark.

Defined cases: a read of no value answers null; a lookup with null outcome is a failure; rows of one time count in
order of seq; null keys are a session of their own; other operations answer null and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of requests besides the session's key: ts (for the watermark), at (the same in microseconds) and these.
REQUEST = "seq long, op string, name string, value string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, idle: int, found_for: int, failed_for: int) -> None:
        self.key, self.idle, self.found_for, self.failed_for = key, idle, found_for, failed_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The value, if it is alive, and when it was last touched; until when the last of the lookups is good; the timer.
        self.session = handle.getValueState("session", "value string, alive boolean, touched long, latest long, timer long")
        self.lookups = handle.getMapState("lookups", "name string", "title string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.session.get()
        value, alive, touched, latest, timer = held or (None, False, None, None, None)
        good, known, made, out = latest, {}, [], []
        # Lists, as frames of a few rows cost more than their rows.
        requests = [r for frame in rows for r in zip(*(frame[c].tolist() for c in ("at", "seq", "op", "name", "value")), strict=True)]
        for at, seq, op, name, given in sorted(requests, key=lambda r: (r[0], r[1] != r[1], r[1])):
            answer, asked = None, False
            given = given if isinstance(given, str) else None
            if alive and at > touched + self.idle:
                alive = False
            if op == "put":
                value, touched, alive = given, at, True
            elif op in ("get", "take") and alive:
                answer, touched, alive = value, at, op == "get"
            elif op == "lookup":
                name = name if isinstance(name, str) else ""
                if name not in known:
                    known[name] = self.lookups.getValue((name,)) if good is not None and at <= good else None
                if known[name] is None or at > known[name][1]:
                    known[name], asked = (given, int(at) + (self.failed_for if given is None else self.found_for)), True
                    made.append(name)
                    latest = max(known[name][1], latest or 0)
                answer = known[name][0]
            out.append((seq, op, answer, asked))
        for name in dict.fromkeys(made):
            self.lookups.updateValue((name,), known[name])
        self._keep(held, (value, True, int(touched), latest) if alive else (None, False, None, latest), timer)
        yield pd.DataFrame({self.key: [key[0]] * len(out)} | dict(zip(("seq", "op", "answer", "asked"), map(list, zip(*out, strict=True)), strict=True)))

    def _keep(self, held: tuple | None, state: tuple, timer: int | None) -> None:
        """Keep a session that has a value or lookups, under its timer or one for when the last of them is out."""
        _, alive, touched, latest = state
        if not alive and latest is None:
            if held is not None:
                self.session.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
            return
        if timer is None:
            timer = max(latest or 0, touched + self.idle if alive else 0) // 1000 + 1
            self.handle.registerTimer(timer)
        if held is None or tuple(held) != (*state, timer):
            self.session.update((*state, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.session.get()
        if held is None or held[4] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        # Rows up to the watermark are late, so no row can see what was out before.
        now, (value, alive, touched, latest, _) = timerValues.getCurrentWatermarkInMs() * 1000, held
        if not alive or touched + self.idle < now:
            value, alive, touched = None, False, None
        if latest is not None and latest < now:
            self.lookups.clear()
            latest = None
        elif latest is not None:
            for name in [n for n, e in self.lookups.iterator() if e[1] < now]:
                self.lookups.removeKey(name)
        # Spark removes the timer that fired.
        self._keep(held, (value, alive, touched, latest), None)
        return iter(())

    def close(self) -> None:
        pass


def answered(requests: DataFrame, key: str, idle: int, found_for: int, failed_for: int, late: str = "0 seconds") -> DataFrame:
    """key, seq, op, answer, asked for each request of a stream (key, ts, at and REQUEST's columns).

    idle: microseconds after which an untouched value is gone; found_for and failed_for: how long lookups answer by
    themselves. `asked` marks lookups that had to be made.
    """
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.withWatermark("ts", late).groupBy(key)
    return rows.transformWithStateInPandas(_Sessions(key, idle, found_for, failed_for), f"{key} {kind}, seq long, op string, answer string, asked boolean", "append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run(answers: DataFrame, sink: str, checkpoint: str) -> None:
    """Answer all that the source has, from where the checkpoint left off, into a Parquet folder."""
    with rocksdb(answers.sparkSession):
        query = answers.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
