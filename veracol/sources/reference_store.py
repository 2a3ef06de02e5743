"""References by key, overwritten when they come anew: base files, deltas and tombstones under versions.

A batch writes its rows (or the keys that it removes) as a part of its own and then a version: the list of parts that
make the store, in order. A version's folder gets its name by one rename, which fails where another writer has it; the
batch is then based on that one. Reading a version merges its parts: of each key the last part that names it counts,
with all its rows there, and a removed key has none. Compacting merges the parts into one base, dealt by key, and keeps
the ids of the batches in it. Parts never change, so a reader of an older version isn't disturbed.

Defined cases: a batch id counts once, also after compacting; rows with a null key are kept out (nothing could name
them again); a batch may bring several rows of a key; an empty batch makes a version with the same rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.sources.stored import published_folder, publish_folder

#: A version's rows: base or delta with its place in the order, or the ids of compacted batches.
VERSION = "kind string, path string, seq long, batch_id string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    #: Columns of a row; `key` names it.
    schema: str
    key: str = "key"

    def versions(self) -> list[int]:
        return sorted(int(n) for n in published_folder(self.spark, f"{self.path}/versions"))

    def _version(self, version: int) -> list:
        """A version's rows; as many as there were batches since the last compacting."""
        if version == 0:
            return []
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{version:012d}").orderBy("seq").collect()

    def holds(self, batch_id: str, version: int | None = None) -> bool:
        rows = self._version(max(self.versions(), default=0) if version is None else version)
        if any(r.batch_id == batch_id for r in rows):
            return True
        ids = [r.path for r in rows if r.kind == "ids"]
        return bool(ids) and bool(self.spark.read.schema("batch_id string").parquet(*ids).where(F.col("batch_id") == batch_id).take(1))

    def _committed(self, batch_id: str, part: str) -> bool:
        """Add a part to the latest version, whichever that is by then."""
        while True:
            latest = max(self.versions(), default=0)
            if self.holds(batch_id, latest):
                return False
            rows = [tuple(r) for r in self._version(latest)]
            rows.append(("delta", part, max((r[2] for r in rows), default=0) + 1, batch_id))
            if self._named(latest + 1, rows):
                return True

    def _named(self, version: int, rows: list[tuple]) -> bool:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(draft)
        return publish_folder(self.spark, draft, f"{self.path}/versions/{version:012d}")

    def ingest(self, rows: DataFrame, batch_id: str) -> bool:
        """Rows that replace those of their keys; False, and no change, for a batch that is in the store."""
        return self._written(rows.select(*self._columns(), F.lit(False).alias("removed")), batch_id)

    def remove(self, keys: DataFrame, batch_id: str) -> bool:
        """Take out the rows of keys (a table with the key's column)."""
        kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in self.schema.split(", ")}
        gone = keys.select(*[F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self._columns()]).distinct()
        return self._written(gone.withColumn("removed", F.lit(True)), batch_id)

    def _columns(self) -> list[str]:
        return [f.split(" ")[0] for f in self.schema.split(", ")]

    def _written(self, rows: DataFrame, batch_id: str) -> bool:
        if self.holds(batch_id):
            return False
        part = f"{self.path}/parts/{uuid.uuid4().hex}"
        rows.where(F.col(self.key).isNotNull()).write.parquet(part)
        return self._committed(batch_id, part)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        latest = max(self.versions(), default=0) if version is None else version
        parts = [r for r in self._version(latest) if r.kind != "ids"]
        rows = {r.seq: self.spark.read.schema(f"{self.schema}, removed boolean").parquet(r.path) for r in parts}
        # A part's rows meet the keys of later parts alone: those of the last part needn't move, nor any others' texts than
        # those that may be replaced.
        out, later = self.spark.createDataFrame([], self.schema), None
        for seq in sorted(rows, reverse=True):
            here = rows[seq].where("NOT removed").select(*self._columns())
            if later is not None:
                here = here.join(later, F.col(self.key) == F.col("_key"), "left_anti")
            out = out.unionByName(here)
            keys = rows[seq].select(F.col(self.key).alias("_key"))
            later = keys if later is None else later.unionByName(keys)
        return out

    def compact(self) -> int:
        """Merge the parts of the latest version into one base; the new version. Batches that come meanwhile are kept."""
        at = max(self.versions(), default=0)
        before = self._version(at)
        base, ids = (f"{self.path}/parts/{uuid.uuid4().hex}" for _ in range(2))
        self.read(at).withColumn("removed", F.lit(False)).repartition(F.col(self.key)).write.parquet(base)
        known = self.spark.createDataFrame([(r.batch_id,) for r in before if r.batch_id is not None], "batch_id string")
        for r in before:
            if r.kind == "ids":
                known = known.unionByName(self.spark.read.schema("batch_id string").parquet(r.path))
        known.distinct().repartitionByRange("batch_id").write.parquet(ids)
        top = max((r.seq for r in before), default=0)
        while True:
            latest = max(self.versions(), default=0)
            late = [tuple(r) for r in self._version(latest) if r.kind == "delta" and r.seq > top]
            if self._named(latest + 1, [("base", base, top, None), ("ids", ids, 0, None), *late]):
                return latest + 1
