"""An event log that a stream writes exactly once, and the stream that reads it.

Each micro-batch writes its rows to a folder that readers skip, then one rename gives the folder its published name, of
the writer and the batch's number. The rename is the record: it fails where the batch is published, so that a batch
that is run again, after a driver was lost before or after the rename, or by a second driver that took over, adds
nothing. Readers follow published folders alone, as a file stream, and so see each row once.

Defined cases: an empty batch publishes an empty folder; what lost drivers leave behind stays unread and can be removed
by `sweep` while no writer runs; rows have the columns of `EVENTS`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veracol.sources.stored import publish_folder

EVENTS = "doc_id long, seq int, event string, data string"
PUBLISHED, DRAFTS = "published", "_drafts"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(hadoop), jvm.org.apache.hadoop.fs.Path


def _place(path: str, writer: str, batch: int) -> str:
    return f"{path}/{PUBLISHED}/writer={writer}/batch={batch:012d}"


def _renamed(spark: SparkSession, path: str, draft: str, place: str) -> bool:
    """Give a draft its published name; False where another has it."""
    return publish_folder(spark, draft, place)


def publish(rows: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Publish a batch's rows; False, and no change, where the batch is published."""
    spark = rows.sparkSession
    files, at = _files(spark, path)
    place = _place(path, writer, batch)
    if files.exists(at(place)):
        return False
    draft = f"{path}/{DRAFTS}/{uuid.uuid4().hex}"
    rows.write.parquet(draft)
    return _renamed(spark, path, draft, place)


def write(source: DataFrame, events: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """Start a stream that publishes events(batch) for each micro-batch of the source, until it has seen all of it.

    writer: the name under which batches are numbered; it belongs to the checkpoint.
    """
    batches = source.writeStream.foreachBatch(lambda rows, number: publish(events(rows), path, writer, number) and None)
    return batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Published rows, as a stream."""
    return spark.readStream.schema(f"{schema}, writer string, batch string").option("basePath", f"{path}/{PUBLISHED}").parquet(f"{path}/{PUBLISHED}/writer=*/batch=*")


def published(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Rows published so far."""
    return spark.read.schema(f"{schema}, writer string, batch string").parquet(f"{path}/{PUBLISHED}")


def sweep(spark: SparkSession, path: str) -> None:
    """Remove what lost drivers left behind."""
    files, at = _files(spark, path)
    files.delete(at(f"{path}/{DRAFTS}"), True)
