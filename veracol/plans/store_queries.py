"""Queries over the reference store and over runs that supersede one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.plans.common import Catalog, scratch, table
from veracol.plans.text_queries import FEATURES, features
from veracol.sources.reference_store import Store
from veracol.streaming.runs import Runs

catalog = Catalog()


@catalog.add(
    "reference_versions",
    """WITH b AS (
  SELECT 1 AS seq, doc_id, text, FALSE AS gone FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT 2, doc_id, upper(source) || text, FALSE FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 3, doc_id, NULL, TRUE FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 4, doc_id, lang || text, FALSE FROM documents WHERE doc_id % 5 = 0),
v AS (SELECT v, b.* FROM (SELECT unnest([1, 2, 3, 4, 5]) AS v) x JOIN b ON b.seq <= x.v),
l AS (SELECT *, max(seq) OVER (PARTITION BY v, doc_id) AS last FROM v)
SELECT v AS version, doc_id, length(text) AS chars, sha256(text) AS digest FROM l WHERE seq = last AND NOT gone""",
)
def reference_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in overlapping batches, one of them delivered again, and compacted: the rows of every version."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, scratch(spark, "references"), "key long, text string")
    rows = lambda where, text: docs.where(where).select(F.col("doc_id").alias("key"), F.expr(text).alias("text"))
    store.ingest(rows("doc_id % 3 <> 0", "text"), "first")
    store.ingest(rows("doc_id % 2 = 0", "upper(source) || text"), "second")
    store.remove(rows("doc_id % 7 = 0", "text").select("key"), "removed")
    store.ingest(rows("doc_id % 5 = 0", "lang || text"), "fourth")
    store.compact()
    store.ingest(rows("doc_id % 3 <> 0", "text"), "first")
    each = [store.read(v).select(F.lit(v).alias("version"), F.col("key").alias("doc_id"), F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")) for v in store.versions()]
    return reduce(DataFrame.unionByName, each)


@catalog.add(
    "fenced_results",
    f"""WITH {FEATURES}, x AS (SELECT doc_id, sent_idx, CASE WHEN n_cliches > 0 THEN 'flagged' ELSE 'passed' END AS status FROM feat)
SELECT doc_id, 2 AS epoch, sent_idx, status FROM x WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, sent_idx, 'first ' || status FROM x WHERE doc_id % 2 <> 0""",
)
def fenced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over documents, the second over every other one; the first one's rows come late."""
    rows = features(spark, sf_dir).select("doc_id", "sent_idx", F.when(F.col("n_cliches") > 0, "flagged").otherwise("passed").alias("status"))
    runs = Runs(spark, scratch(spark, "runs"), "sent_idx int, status string")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    first, second = runs.start(ids), runs.start(ids.where("doc_id % 2 = 0"))
    runs.add(second, "all", rows.where("doc_id % 2 = 0"))
    runs.add(first, "all", rows.withColumn("status", F.concat(F.lit("first "), F.col("status"))))
    return runs.visible().select("doc_id", F.col("epoch").cast("int").alias("epoch"), "sent_idx", "status")
