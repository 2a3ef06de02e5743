"""Interleaved runs, in both orders."""

from __future__ import annotations

import pytest

from veracol.streaming import runs
from veracol.streaming.runs import Runs

IDS = "doc_id long"


@pytest.mark.parametrize("stale_last", [True, False])
def test_a_superseded_run_is_never_seen(spark, tmp_path, stale_last):
    log = Runs(spark, str(tmp_path / "r"), "said string")
    frame = lambda ids, said: spark.createDataFrame([(i, said) for i in ids], "doc_id long, said string")
    seen = lambda: sorted((r.doc_id, r.said) for r in log.visible().collect())
    assert seen() == []
    old = log.start(spark.createDataFrame([(1,), (2,), (3,), (None,)], IDS))
    assert log.add(old, "a", frame([1, 2], "old")) and seen() == [(1, "old"), (2, "old")]
    new = log.start(spark.createDataFrame([(2,), (3,), (3,)], IDS))
    assert new == old + 1 and seen() == [(1, "old")]
    late = [lambda: log.add(old, "b", frame([2, 3, 9], "late")), lambda: log.add(new, "a", frame([2, 3], "new"))]
    for step in reversed(late) if stale_last else late:
        assert step() and ("late" not in {s for _, s in seen()})
    assert not log.add(new, "a", frame([2, 3], "again"))
    assert seen() == [(1, "old"), (2, "new"), (3, "new")]


def test_runs_that_start_at_once_differ(spark, tmp_path, monkeypatch):
    log = Runs(spark, str(tmp_path / "r"), "said string")
    real, other = runs.publish_folder, []

    def raced(spark_, draft, place):
        monkeypatch.setattr(runs, "publish_folder", real)
        other.append(log.start(spark.createDataFrame([(1,)], IDS)))
        return real(spark_, draft, place)

    monkeypatch.setattr(runs, "publish_folder", raced)
    assert log.start(spark.createDataFrame([(1,)], IDS)) == 2 and other == [1]
