"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as a ledger of signed deltas. A batch (inserts,
deletes and revised counts) is reduced to one additive row per group, then committed under its batch id. A
batch id counts once: an attempt writes its rows to a folder of its own, then creates the batch's entry, which names
that folder and which only one attempt can create. Totals join rows with entries, so that a batch that is delivered
again, by two writers at once, late, or after a lost driver, changes nothing, and what totals once counted stays.
Compacting keeps the ids of the batches that it sums, so that these stay known. Entries and ids are read as tables;
the driver only looks up one name.

Defined cases: null or empty text counts 0 tokens; null source or lang is a group of its own; repeated rows
count as often as they occur; an empty batch commits and adds nothing; only the named columns are read, so
extra columns cannot clash.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.llm import byte_bpe
from veracol.llm.common import GAP, discard, scratch_root, text_or_empty, written

GROUP = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
_BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def _marks(text: Column) -> Column:
    # ASCII classes, so that every engine counts alike.
    return F.regexp_count(text, F.lit(r"[0-9]+|[!-/:-@\[-`{-~]")).cast("long")


#: Token counters by tokenizer version: words; words with digits runs and punctuation counted as well.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words-1": _words,
    "words-2": lambda t: _words(t) + _marks(t),
}


def counted(docs: DataFrame, versions: tuple[str, ...] = tuple(COUNTERS)) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n of every document: what later joins need, without its text."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), COUNTERS[v](F.col("text")).alias("n")) for v in versions])
    return base.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.tokenizer_version", "c.n")


def bpe_counted(docs: DataFrame, version: str, rank_path: str, pattern: str) -> DataFrame:
    """The same with the ids that a byte-level BPE vocabulary gives the whole text as its tokens."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    ids = byte_bpe.encoded(rows, rank_path, pattern, keep=("doc_id", "source", "lang"))
    return ids.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.size("ids").cast("long").alias("n"))


def deltas(counts: DataFrame, sign: int = 1) -> DataFrame:
    """Counted documents as signed deltas: one row per group, summed before the shuffle."""
    sums = counts.groupBy(*GROUP).agg((F.count(F.lit(1)) * sign).alias("n_docs"), (F.sum("n") * sign).alias("n_tokens"))
    return sums.select(*GROUP, *SUMS)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that take back the counts of `before` and put those of `after`."""
    both = deltas(before, -1).unionByName(deltas(after, 1))
    return both.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


ENTRIES, DATA, CARRIED = "entries", "data", "carried"


@dataclass(frozen=True)
class Ledger:
    """A rollup's folder: rows by attempt, one entry a published batch, and the ids of batches that were summed up."""

    spark: SparkSession
    path: str

    @classmethod
    def new(cls, spark: SparkSession) -> Ledger:
        return cls(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _entry(self, batch_id: str) -> str:
        return f"{self.path}/{ENTRIES}/batch-{sha256(batch_id.encode()).hexdigest()}"

    def _claimed(self, batch_id: str, attempt: str) -> bool:
        """Create the batch's entry with the attempt's name, whole or not at all; False where there is one."""
        files, path = self._files()
        entry, draft = path(self._entry(batch_id)), path(f"{self.path}/_draft-{attempt}")
        files.mkdirs(entry.getParent())
        out = files.create(draft, False)
        out.write(bytearray(f"{attempt} {batch_id}".encode()))
        out.close()
        if files.getScheme() == "file":
            # A plain rename replaces its target there; a link does not.
            try:
                os.link(draft.toUri().getPath(), entry.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                files.delete(draft, False)
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        rename = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = none
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, entry, rename)
            return True
        except Exception:
            if not files.exists(entry):
                raise
            files.delete(draft, False)
            return False

    def holds(self, batch_id: str) -> bool:
        """Whether the batch is published here, or was in a ledger that this one sums up."""
        files, path = self._files()
        if files.exists(path(self._entry(batch_id))):
            return True
        return bool(self._carried().where(F.col("batch_id") == batch_id).take(1))

    def _carried(self) -> DataFrame:
        files, path = self._files()
        folder = f"{self.path}/{CARRIED}"
        return self.spark.read.schema("batch_id string").parquet(folder) if files.exists(path(folder)) else self.spark.createDataFrame([], "batch_id string")

    def entries(self) -> DataFrame:
        """batch_id and attempt of the published batches."""
        files, path = self._files()
        folder = f"{self.path}/{ENTRIES}"
        if not files.exists(path(folder)):
            return self.spark.createDataFrame([], "batch_id string, attempt string")
        said = F.split("value", " ", 2)
        return self.spark.read.text(folder, wholetext=True).select(said[1].alias("batch_id"), said[0].alias("attempt"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Publish a batch; False, and no change, where its id is published already."""
        if self.holds(batch_id):
            return False
        attempt = uuid.uuid4().hex
        deltas.select(*GROUP, *SUMS).write.parquet(f"{self.path}/{DATA}/attempt={attempt}")
        if self._claimed(batch_id, attempt):
            return True
        files, path = self._files()
        files.delete(path(f"{self.path}/{DATA}/attempt={attempt}"), True)
        return False

    def totals(self) -> DataFrame:
        """The sum of all published batches by group; groups whose counts are all zero are left out."""
        return self._summed(self.entries())

    def _summed(self, entries: DataFrame) -> DataFrame:
        files, path = self._files()
        folder = f"{self.path}/{DATA}"
        if files.exists(path(folder)):
            every = self.spark.read.schema(f"{SCHEMA}, attempt string").parquet(folder)
        else:
            every = self.spark.createDataFrame([], f"{SCHEMA}, attempt string")
        rows = every.join(entries.select("attempt"), "attempt", "left_semi")
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: str) -> Ledger:
        """A ledger at another folder with these totals as one batch, which knows the ids of all that they sum up.

        Both come of the batches that are published at one moment; what is published here later isn't in it.
        """
        other = Ledger(self.spark, into)
        seen = written(self.entries(), "ledger_entries")
        # Ids first: a compaction that is lost half-way leaves a ledger that refuses batches, not one that counts them twice.
        seen.select("batch_id").unionByName(self._carried()).distinct().repartitionByRange("batch_id").write.parquet(f"{into}/{CARRIED}")
        other.commit(f"compacted-{uuid.uuid4().hex}", self._summed(seen))
        discard(seen)
        return other


#: Lines that a revision of the corpus takes out.
LICENSE_LINE = "(?m)^Licensed under [^\\n]*$"


def maintained(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches: inserts, documents labelled as of low quality deleted, texts revised to
    have no license lines, and the first batch delivered again."""
    ledger = Ledger.new(docs.sparkSession)
    counts = written(counted(docs), "token_counts")
    low = labels.where("quality = 0").select(F.col("doc_id").alias("_low")).distinct()
    is_low = F.col("doc_id") == F.col("_low")
    ledger.commit("inserts", deltas(counts))
    ledger.commit("deletes", deltas(counts.join(low, is_low, "left_semi"), -1))
    licensed = docs.where(F.col("text").contains("Licensed under "))
    stripped = licensed.withColumn("text", F.regexp_replace("text", LICENSE_LINE, ""))
    # Counts are written first: the optimiser would join before it counts, and so shuffle the texts.
    before, after = (written(counted(x), "revised_counts").join(low, is_low, "left_anti") for x in (licensed, stripped))
    ledger.commit("revisions", revised(before, after))
    ledger.commit("inserts", deltas(counts))
    return ledger.totals()


ORACLE = r"""
WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
stay AS (
  SELECT source, lang, regexp_replace(coalesce(text, ''), '(?m)^Licensed under [^\n]*$', '', 'g') AS t
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM low WHERE doc_id IS NOT NULL)),
sized AS (
  SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(t, '[0-9]+|[!-/:-@\[-`{-~]')) AS marks FROM stay),
versions AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, words AS n FROM sized
  UNION ALL SELECT source, lang, 'words-2', words + marks FROM sized)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM versions GROUP BY ALL
"""
