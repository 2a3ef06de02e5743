"""Tables that a job writes for itself, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the session names; a temporary one only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="veracol-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: a lost executor costs a re-read, not a recomputation."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish_folder(spark: SparkSession, draft: str, place: str) -> bool:
    """Give a draft folder its final name by one rename; False, and the draft removed, where another has it."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(place)
    files = source.getFileSystem(hadoop)
    files.mkdirs(target.getParent())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), hadoop).rename(source, target, options)
        return True
    except Exception:
        # Whoever failed to rename must find the name taken, else the failure is a real one.
        if not files.exists(target):
            raise
        files.delete(source, True)
        return False


def published_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
