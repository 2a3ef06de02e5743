"""The event log over drivers that are lost before and after a batch is published."""

from __future__ import annotations

from pathlib import Path

import pytest

from veracol.plans.stream_queries import sentence_events
from veracol.streaming import event_log

SCHEMA = "doc_id long, text string"


def test_lost_drivers_add_nothing(spark, tmp_path, monkeypatch):
    source, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    source.mkdir()
    docs = [(i, f"First of the {i}. Second in the row. Third") for i in range(12)] + [(90, ""), (91, None)]
    for i in range(3):
        spark.createDataFrame(docs[i * 5 : i * 5 + 5], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        for part in (tmp_path / f"w{i}").glob("part-*.parquet"):
            part.rename(source / f"{i}.parquet")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    real, lost = event_log._renamed, []

    def dying(*args):
        """Batch 1 is lost before it is published, batch 2 right after."""
        batch = int(args[3].rsplit("=", 1)[1])
        if batch == 1 and "before" not in lost:
            lost.append("before")
            raise OSError("lost")
        done = real(*args)
        if batch == 2 and "after" not in lost:
            lost.append("after")
            raise OSError("lost")
        return done

    monkeypatch.setattr(event_log, "_renamed", dying)
    seen = []
    for run in range(3):
        query = event_log.write(stream(), sentence_events, log, checkpoint, "w")
        if run < 2:
            with pytest.raises(Exception):  # noqa: B017
                query.awaitTermination()
        else:
            query.awaitTermination()
        # A reader with its own checkpoint follows what is published so far.
        out = event_log.read(spark, log).writeStream.format("parquet").option("path", str(tmp_path / "seen")).option("checkpointLocation", str(tmp_path / "reader")).trigger(availableNow=True).start()
        out.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "seen")).count())
    assert lost == ["before", "after"] and seen[0] < seen[1] and seen[1] == seen[2]
    assert list(Path(log, event_log.DRAFTS).iterdir())  # what the first driver left is there, and unread
    want = sorted(tuple(r) for r in sentence_events(spark.createDataFrame(docs, SCHEMA)).collect())
    columns = ["doc_id", "seq", "event", "data"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "seen")).select(columns).collect()) == want
    assert sorted(tuple(r) for r in event_log.published(spark, log).select(columns).collect()) == want
    event_log.sweep(spark, log)
    assert event_log.published(spark, log).count() == len(want)


def test_a_batch_is_published_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "init", "{}")], event_log.EVENTS)
    assert event_log.publish(rows, str(tmp_path), "w", 7) and not event_log.publish(rows.union(rows), str(tmp_path), "w", 7)
    draft = f"{tmp_path}/{event_log.DRAFTS}/other"
    rows.write.parquet(draft)
    # Another driver that looked before the batch was published comes too late.
    assert not event_log._renamed(spark, str(tmp_path), draft, event_log._place(str(tmp_path), "w", 7))
    assert event_log.publish(rows, str(tmp_path), "other", 7)
    assert event_log.published(spark, str(tmp_path)).count() == 2
