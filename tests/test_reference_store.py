"""The reference store against a dictionary, with compacting, late writers and old readers."""

from __future__ import annotations

from veracol.sources import reference_store
from veracol.sources.reference_store import Store

SCHEMA = "key string, n int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_compacting_and_redelivery(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA)
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(store.read()) == [] and store.versions() == []
    assert store.ingest(frame([("a", 1), ("a", 2), ("b", 1), (None, 9)]), "one")
    assert store.ingest(frame([("b", 5), ("c", 5)]), "two") and not store.ingest(frame([("b", 6)]), "two")
    assert store.remove(spark.createDataFrame([("a",), ("zz",)], "key string"), "three")
    old = store.read(1)
    want = {1: [("a", 1), ("a", 2), ("b", 1)], 2: [("a", 1), ("a", 2), ("b", 5), ("c", 5)], 3: [("b", 5), ("c", 5)]}
    assert {v: rows(store.read(v)) for v in store.versions()} == want
    assert store.compact() == 4 and rows(store.read()) == want[3] and rows(old) == want[1]
    for batch in ("one", "two", "three"):
        assert not store.ingest(frame([("q", 1)]), batch)
    assert store.ingest(frame([("a", 7)]), "four") and store.ingest(frame([]), "five")
    assert rows(store.read()) == [("a", 7), ("b", 5), ("c", 5)]
    assert store.compact() == 7 and not store.ingest(frame([("q", 1)]), "one") and not store.remove(spark.createDataFrame([("a",)], "key string"), "four")
    assert rows(store.read()) == [("a", 7), ("b", 5), ("c", 5)] and {v: rows(store.read(v)) for v in (1, 2, 3)} == want


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), SCHEMA)
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    store.ingest(frame([("a", 1)]), "one")
    real, between = reference_store.publish_folder, []

    def raced(spark_, draft, place):
        """Another writer takes the version's name just before."""
        if not between:
            between.append(place)
            monkeypatch.setattr(reference_store, "publish_folder", real)
            assert store.ingest(frame([("b", 2)]), "two")
        return real(spark_, draft, place)

    monkeypatch.setattr(reference_store, "publish_folder", raced)
    assert store.ingest(frame([("c", 3)]), "three")
    assert rows(store.read()) == [("a", 1), ("b", 2), ("c", 3)] and store.versions() == [1, 2, 3]
    # The same while compacting: what comes meanwhile is kept.
    between.clear()
    monkeypatch.setattr(reference_store, "publish_folder", lambda *x: raced_batch(*x))

    def raced_batch(spark_, draft, place):
        monkeypatch.setattr(reference_store, "publish_folder", real)
        assert store.ingest(frame([("a", 4)]), "four")
        return real(spark_, draft, place)

    store.compact()
    assert rows(store.read()) == [("a", 4), ("b", 2), ("c", 3)]
    assert not store.ingest(frame([("z", 0)]), "one") and not store.ingest(frame([("z", 0)]), "four")
