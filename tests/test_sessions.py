"""Sessions over several batches, each in a run of its own from the last one's checkpoint."""

from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, datetime
from types import SimpleNamespace

import pandas as pd

from veracol.streaming import sessions

SCHEMA = "user string, ts timestamp, at long, " + sessions.REQUEST
HOUR = 3_600_000_000
START = 1_700_000_000_000_000


def answers(spark, folder, batches, idle=2 * HOUR, found_for=5 * HOUR, failed_for=HOUR):
    source = folder / "in"
    source.mkdir(exist_ok=True)
    out = []
    for i, batch in enumerate(batches):
        rows = [(u, datetime.fromtimestamp(at / 1e6, UTC), at, seq, op, name, value) for u, at, seq, op, name, value in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"w{i}"))
        for part in (folder / f"w{i}").glob("part-*.parquet"):
            part.rename(source / f"{i}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        sessions.run(sessions.answered(stream, "user", idle, found_for, failed_for), str(folder / "out"), str(folder / "cp"))
        out.append({(r.user, r.seq): (r.answer, r.asked) for r in spark.read.parquet(str(folder / "out")).collect()})
    return out


def at(hours: float) -> int:
    return START + int(hours * HOUR)


def test_expiry_refresh_take_and_restart(spark, tmp_path):
    got = answers(spark, tmp_path, [
        [("a", at(0), 1, "put", None, "v"), ("b", at(0), 2, "put", None, "w"), ("c", at(0), 3, "put", None, "x")],
        # a is read in time and so made young again; b isn't; c is taken.
        [("a", at(1.5), 4, "get", None, None), ("c", at(1.6), 5, "take", None, None), ("c", at(1.7), 6, "take", None, None)],
        [("a", at(3.4), 7, "get", None, None), ("b", at(3.4), 8, "get", None, None), ("c", at(3.4), 9, "get", None, None), ("d", at(3.4), 10, "get", None, None)],
        # Long after: timers have fired; what was put is gone, and can be put anew.
        [("a", at(30), 11, "get", None, None), ("a", at(30), 12, "put", None, "new"), ("a", at(30), 13, "get", None, None)],
    ])[-1]
    assert {k[1]: v[0] for k, v in got.items()} == {1: None, 2: None, 3: None, 4: "v", 5: "x", 6: None, 7: "v", 8: None, 9: None, 10: None, 11: None, 12: None, 13: "new"}


def test_failed_lookups_are_asked_again_after_their_time(spark, tmp_path):
    got = answers(spark, tmp_path, [
        [("a", at(0), 1, "lookup", "k", None), ("a", at(0.5), 2, "lookup", "k", "found since"), ("a", at(0.5), 3, "lookup", "m", "title")],
        [("a", at(0.9), 4, "lookup", "k", "found since"), ("b", at(0.9), 5, "lookup", "k", "of b")],
        [("a", at(1.5), 6, "lookup", "k", "found since"), ("a", at(4), 7, "lookup", "m", None), ("a", at(6), 8, "lookup", "m", None), ("a", at(6.1), 9, "lookup", "k", None)],
    ])[-1]
    assert {k[1]: v for k, v in got.items()} == {
        1: (None, True), 2: (None, False), 3: ("title", True), 4: (None, False), 5: ("of b", True), 6: ("found since", True), 7: ("title", False), 8: (None, True), 9: ("found since", False),
    }


def test_against_a_dictionary_whatever_the_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, now = [], START
    for seq in range(300):
        now += rng.choice([0, HOUR // 10, HOUR, 2 * HOUR, 3 * HOUR])
        op = rng.choice(["put", "get", "get", "take", "lookup", "lookup"])
        rows.append((rng.choice("ab"), now, seq, op, rng.choice("kmn"), rng.choice([None, f"v{seq}"]) if op == "lookup" else f"v{seq}"))
    values, looked, want = {}, {}, {}
    for user, t, seq, op, name, value in rows:
        answer, asked = None, False
        if user in values and t > values[user][1] + 2 * HOUR:
            del values[user]
        if op == "put":
            values[user] = (value, t)
        elif op in ("get", "take") and user in values:
            answer = values[user][0]
            values[user] = (answer, t)
            if op == "take":
                del values[user]
        elif op == "lookup":
            if (user, name) not in looked or t > looked[user, name][1]:
                looked[user, name], asked = (value, t + (HOUR if value is None else 5 * HOUR)), True
            answer = looked[user, name][0]
        want[user, seq] = (answer, asked)
    for i, cuts in enumerate(([300], [100, 101, 230, 300])):
        folder = tmp_path / str(i)
        folder.mkdir()
        assert answers(spark, folder, [rows[a:z] for a, z in zip([0, *cuts], cuts, strict=False)])[-1] == want


class Handle:
    """State of one session in dictionaries, with the calls that each would be a trip to the executor."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), Counter()
        self.session = SimpleNamespace(**{n: self.counted(n, getattr(self, f"_{n}")) for n in ("get", "update", "clear")})
        self.lookups = SimpleNamespace(
            getValue=self.counted("getValue", self.map.get), updateValue=self.counted("updateValue", self.map.__setitem__), removeKey=self.counted("removeKey", self.map.pop),
            clear=self.counted("clearMap", self.map.clear), iterator=self.counted("iterator", lambda: iter(list(self.map.items()))),
        )
        self.registerTimer, self.deleteTimer = self.counted("registerTimer", self.timers.add), self.counted("deleteTimer", self.timers.remove)
        self.getValueState, self.getMapState = (lambda *_: self.session), (lambda *_: self.lookups)

    def counted(self, name, call):
        return lambda *a: (self.calls.update([name]), call(*a))[1]

    def _get(self):
        return self.value

    def _update(self, value):
        self.value = value

    def _clear(self):
        self.value = None


def test_a_session_takes_few_trips_and_one_timer():
    handle, processor = Handle(), sessions._Sessions("user", 2 * HOUR, 5 * HOUR, HOUR)
    processor.init(handle)

    def batch(*rows):
        handle.calls.clear()
        frames = [pd.DataFrame([("a", *r)], columns=["user", "at", "seq", "op", "name", "value"]) for r in rows]
        return [x for out in processor.handleInputRows(("a",), iter(frames), None) for x in out["answer"]]

    def expired(hours):
        handle.calls.clear()
        now = at(hours) // 1000
        for due in sorted(x for x in handle.timers if x <= now):
            list(processor.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda due=due: due)))
            handle.timers.discard(due)

    assert batch((at(0), 1, "put", None, "v"), (at(0), 2, "lookup", "k", "t"), (at(0), 3, "lookup", "m", None), (at(0.1), 4, "lookup", "k", "u")) == [None, "t", None, "t"]
    assert handle.calls == {"get": 1, "updateValue": 2, "update": 1, "registerTimer": 1} and handle.timers == {at(5) // 1000 + 1}
    # What changes nothing is read, not written.
    assert batch((at(0.2), 5, "lookup", "k", "w")) == ["t"] and handle.calls == {"get": 1, "getValue": 1}
    # What came since sets the timer anew; what is out goes.
    assert batch((at(4.5), 6, "put", None, "y"), (at(4.5), 7, "lookup", "n", None)) == [None, None] and len(handle.timers) == 1
    expired(5.2)
    assert set(handle.map) == {("n",)} and handle.value[:2] == ("y", True) and handle.timers == {at(6.5) // 1000 + 1}
    expired(7)
    assert handle.map == {} and handle.value is None and not handle.timers
    assert handle.calls == {"get": 1, "clearMap": 1, "clear": 1}
    # What is taken leaves nothing.
    assert batch((at(7), 8, "put", None, "x")) == [None] and batch((at(7), 9, "take", None, None)) == ["x"]
    assert handle.value is None and not handle.timers
