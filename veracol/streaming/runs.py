"""Runs over documents that supersede one another: a stale run's rows are never seen.

Starting a run gives it an epoch, the next number, by naming a folder that lists its documents; of two that start at
once each gets its own. Results carry their run's epoch and may come at any time, in any order and more than once in
parts. What is visible are the rows of each document's latest epoch alone, so a superseded run's late rows stay unseen
without any coordination, and a document whose new run has no rows yet has none.

Defined cases: a document in no run has no rows, though results name it; null ids are kept out; a part that is
written again under its name counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.sources.stored import publish_folder, published_folder


@dataclass(frozen=True)
class Runs:
    spark: SparkSession
    path: str
    #: Columns of results besides the key.
    schema: str
    key: str = "doc_id"
    key_type: str = "long"

    def start(self, keys: DataFrame) -> int:
        """A new run over the keys' documents, which supersedes earlier ones there; its epoch."""
        while True:
            draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
            keys.select(F.col(self.key).cast(self.key_type).alias(self.key)).where(F.col(self.key).isNotNull()).distinct().write.parquet(draft)
            epoch = 1 + max((int(n.removeprefix("epoch=")) for n in published_folder(self.spark, f"{self.path}/runs")), default=0)
            if publish_folder(self.spark, draft, f"{self.path}/runs/epoch={epoch}"):
                return epoch

    def add(self, epoch: int, part: str, results: DataFrame) -> bool:
        """A part of a run's results; False, and no change, where the part is there."""
        if part in (n.removeprefix("part=") for n in published_folder(self.spark, f"{self.path}/results/epoch={epoch}")):
            return False
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        results.select(self.key, *[f.split(" ")[0] for f in self.schema.split(", ")]).write.parquet(draft)
        return publish_folder(self.spark, draft, f"{self.path}/results/epoch={epoch}/part={part}")

    def current(self) -> DataFrame:
        """key and the epoch of its latest run."""
        kind = f"{self.key} {self.key_type}"
        if not published_folder(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], f"{kind}, epoch long")
        return self.spark.read.schema(f"{kind}, epoch long").parquet(f"{self.path}/runs").groupBy(self.key).agg(F.max("epoch").alias("epoch"))

    def visible(self) -> DataFrame:
        """key, epoch and results of each document's latest run."""
        columns = f"{self.key} {self.key_type}, {self.schema}, epoch long, part string"
        if not published_folder(self.spark, f"{self.path}/results"):
            return self.spark.createDataFrame([], columns).drop("part")
        return self.spark.read.schema(columns).parquet(f"{self.path}/results").drop("part").join(self.current(), [self.key, "epoch"])
