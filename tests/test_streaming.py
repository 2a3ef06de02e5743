"""State of streams over several batches."""

from __future__ import annotations

import time

from veracol.streaming import state


def test_a_taken_session_is_gone(spark, tmp_path):
    rows = [[("s", 1, "put", "v"), ("t", 1, "get", None)], [("s", 2, "get", None)], [("s", 3, "take", None), ("s", 4, "get", None)]]
    schema = "session_id string, seq long, op string, value string"
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    # A stream with processing-time timeouts runs batches for ever; it is stopped once it has read all rows.
    query = state.sessions(stream, 3_600_000).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for i, batch in enumerate(rows):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
            for part in (tmp_path / f"w{i}").glob("part-*.parquet"):
                part.rename(source / f"{i}.parquet")
            seen, end = 0, time.time() + 60
            while seen < sum(map(len, rows[: i + 1])) and time.time() < end:
                time.sleep(0.3)
                seen = sum(p["numInputRows"] for p in query.recentProgress)
    finally:
        query.stop()
    got = sorted((r.session_id, r.seq, r.value) for r in spark.read.parquet(str(sink)).collect())
    assert got == [("s", 2, "v"), ("s", 3, "v"), ("s", 4, None), ("t", 1, None)]
