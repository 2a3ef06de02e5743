"""Queries that run the given tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.operators import report, risk, sentences
from veracol.plans.common import Catalog, scratch, table
from veracol.plans.text_queries import CLICHES, CONNECTORS, FEATURES
from veracol.streaming import event_log, sessions

catalog = Catalog()

_HOUR = 3_600_000_000
IDLE, FOUND_FOR, FAILED_FOR = 48 * _HOUR, 240 * _HOUR, 72 * _HOUR
#: What a user's event asks of their session: errors are lookups that fail, clicks such that find something.
_OPS = {"signup": "put", "view": "get", "purchase": "take", "click": "lookup", "error": "lookup"}
_OP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items()) + " END"


@catalog.add(
    "session_answers",
    f"""WITH RECURSIVE r AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS us, {_OP} AS op, CAST(event_id % 5 AS VARCHAR) AS name, CASE WHEN event_type <> 'error' THEN props END AS value FROM events),
v AS (SELECT *, lag(op) OVER w AS prior, lag(us) OVER w AS last_at FROM r WHERE op <> 'lookup' WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
-- A value is cut off by a take before this row, or by more than the idle time since the row before.
b AS (SELECT *, sum(CAST(coalesce(prior = 'take' OR us > last_at + {IDLE}, FALSE) AS INT)) OVER (PARTITION BY user_id ORDER BY us, seq) AS cuts FROM v),
p AS (SELECT *, last_value(CASE WHEN op = 'put' THEN {{'v': value, 'c': cuts}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq) AS put FROM b),
l AS (SELECT *, us + CASE WHEN value IS NULL THEN {FAILED_FOR} ELSE {FOUND_FOR} END AS good_until, row_number() OVER (PARTITION BY user_id, name ORDER BY us, seq) AS rn FROM r WHERE op = 'lookup'),
chain AS (SELECT user_id, name, rn, seq, value AS answer, good_until, TRUE AS asked FROM l WHERE rn = 1 UNION ALL
  SELECT n.user_id, n.name, n.rn, n.seq, CASE WHEN n.us > c.good_until THEN n.value ELSE c.answer END, CASE WHEN n.us > c.good_until THEN n.good_until ELSE c.good_until END, n.us > c.good_until
  FROM chain c JOIN l n ON n.user_id = c.user_id AND n.name = c.name AND n.rn = c.rn + 1)
SELECT user_id, seq, op, CASE WHEN op <> 'put' AND put.c = cuts THEN put.v END AS answer, FALSE AS asked FROM p UNION ALL SELECT user_id, seq, 'lookup', answer, asked FROM chain""",
)
def session_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as requests to their session, answered by a stream until it has seen all of them."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id", "ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS at", "event_id AS seq", f"{_OP} AS op", "CAST(event_id % 5 AS STRING) AS name", "CASE WHEN event_type <> 'error' THEN props END AS value"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    source, sink, checkpoint = (scratch(spark, f"sessions-{n}") for n in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    answers = sessions.answered(stream, "user_id", IDLE, FOUND_FOR, FAILED_FOR)
    sessions.run(answers, sink, checkpoint)
    return spark.read.schema(answers.schema).parquet(sink)


def sentence_events(docs: DataFrame) -> DataFrame:
    """The events of a batch of documents: one a sentence, between an opening and a closing one."""
    rows = sentences.features(sentences.split(docs.repartition("doc_id")), CLICHES, CONNECTORS)
    status = F.when(F.col("n_cliches") > 0, "flagged").otherwise("passed")
    results = risk.running_risks(rows, keep=("sentence", "n_cliches"))
    return report.events(results.select("doc_id", F.col("sent_idx").alias("idx"), F.col("sentence").alias("text"), status.alias("status"), *risk.RISKS))


@catalog.add(
    "event_log",
    f"""WITH {FEATURES}, n AS (SELECT doc_id, count(*) AS n FROM feat GROUP BY doc_id), body AS (SELECT doc_id, CAST(sent_idx + 2 AS INTEGER) AS seq, 'result' AS event, CASE WHEN n_cliches > 0 THEN 'flagged' ELSE 'passed' END AS said, length(sentence) AS chars FROM feat)
SELECT * FROM body UNION ALL SELECT doc_id, 1, 'init', CAST(n AS VARCHAR), 0 FROM n UNION ALL SELECT doc_id, CAST(n + 2 AS INTEGER), 'done', '', 0 FROM n""",
)
def event_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files into the event log; what its readers then see."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    source, log, checkpoint = (scratch(spark, f"event-{n}") for n in ("source", "log", "state"))
    docs.write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", 1 << 30).parquet(source)
    event_log.write(stream, sentence_events, log, checkpoint, "sentences").awaitTermination()
    said = F.coalesce(F.get_json_object("data", "$.status"), F.get_json_object("data", "$.sentences"), F.lit(""))
    chars = F.coalesce(F.length(F.get_json_object("data", "$.text")), F.lit(0)).cast("long")
    return event_log.published(spark, log).select("doc_id", "seq", "event", said.alias("said"), chars.alias("chars"))
