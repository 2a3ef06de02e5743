"""Queries over model answers, reports, sources and streams."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.functions import model_json
from veracol.functions.lexicons import BIBLIOGRAPHY_HEADERS
from veracol.operators import models, report, risk, sentences
from veracol.plans import text_queries
from veracol.plans.common import Catalog, Rows, scratch, table
from veracol.sources import bibtex
from veracol.streaming import state

catalog = Catalog()

BIB = Rows("bib", "id long, text string", [
    (1, '@article{Smith2020,\n title = {Deep {} nets},\n author = "Smith, J.", year = 2020, journal = {Nature}}\n@inproceedings{doe_21, title={A title}, booktitle={Proc. X}, year={2021}}'),
    (2, "@book{k1, title = {First}}\n@book{k1, title = {Second}, author = {Roe}}\n@broken{"), (3, ""),
])
_HEAD = r"(?s)^([a-zA-Z0-9_-]+)\s*\{\s*([a-zA-Z0-9_.:-]+)\s*,\s*(.*)$"
_FIELD = r'([a-zA-Z0-9_-]+)\s*=\s*(?:\{([^{}]*)\}|"([^"]*)"|([a-zA-Z0-9_-]+))'
_VALUES = lambda name: f"coalesce(list_filter(f, lambda x: x.k = '{name}' AND x.v <> '')[-1].v, '')"


@catalog.add(
    "bibtex_parse",
    rf"""WITH {BIB.sql()}, c AS (SELECT id, unnest(string_split(text, '@')) AS c, unnest(range(len(string_split(text, '@')))) AS n FROM bib),
h AS (SELECT id, n, lower(regexp_extract(c, '{_HEAD}', 1)) AS type, regexp_extract(c, '{_HEAD}', 2) AS cite_key, regexp_extract(c, '{_HEAD}', 3) AS body FROM c WHERE regexp_matches(c, '{_HEAD}')),
g AS (SELECT *, regexp_extract_all(body, '{_FIELD}', 1) AS k, regexp_extract_all(body, '{_FIELD}', 2) AS a, regexp_extract_all(body, '{_FIELD}', 3) AS b, regexp_extract_all(body, '{_FIELD}', 4) AS d FROM h),
f AS (SELECT id, n, type, cite_key, list_transform(range(1, len(k) + 1), lambda i: struct_pack(k := lower(k[i]), v := trim(concat(a[i], b[i], d[i])))) AS f FROM g),
e AS (SELECT id, cite_key, type, {_VALUES('title')} AS title, {_VALUES('author')} AS author, {_VALUES('year')} AS year, CASE WHEN {_VALUES('journal')} <> '' THEN {_VALUES('journal')} ELSE {_VALUES('booktitle')} END AS journal, row_number() OVER (PARTITION BY id, cite_key ORDER BY n DESC) AS r FROM f)
SELECT id, cite_key, type, title, author, year, journal FROM e WHERE r = 1""",
)
def bibtex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bibtex.entries(BIB.df(spark), "id", "text")


MANUSCRIPT = Rows("m", "doc_id long, text string", [
    (1, "First prose sentence. Second one here. References. 1. Entry one. 2. Entry two"), (2, "No header. At all"), (3, "  Lead. Литература. x"),
])
_PLACE = "CASE " + " ".join(f"WHEN contains(lower(text), '{h}') THEN length(text) - instr(reverse(lower(text)), '{h[::-1]}') - {len(h) - 1}" for h in BIBLIOGRAPHY_HEADERS) + " ELSE -1 END"


@catalog.add(
    "bibliography_flags",
    rf"""WITH {MANUSCRIPT.sql()}, p AS (SELECT doc_id, {_PLACE} AS header, unnest(string_split(text, '. ')) AS piece, unnest(range(len(string_split(text, '. ')))) AS n FROM m),
s AS (SELECT *, coalesce(sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(ltrim(piece)) AS start FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS sent_idx, trim(piece) AS sentence, header >= 0 AND start >= header AS is_bibliography FROM s WHERE trim(piece) <> ''""",
)
def bibliography_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.bibliography_flags(MANUSCRIPT.df(spark), BIBLIOGRAPHY_HEADERS)


ANSWERS = Rows("answers", "id long, answer string", [
    (1, '<think>because</think>\n```json\n{"issues": [{"issue_type": "style_a", "severity": "low"}]}\n```'), (2, 'prose only</think> Here: {"issues": []} done'),
    (3, "<think>never ends"), (4, '{"issues": [{"issue_type": "cut", "severity": "hi'), (5, '{"a": "line\nbreak", "b": [1, 2,],}'), (6, "no json"), (7, ""), (8, "{'issues': [], 'ok': True}"),
])


@catalog.add("json_clean_repair")
def json_clean_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames):
        for f in frames:
            split = [model_json.cleaned(a) for a in f.answer]
            yield pd.DataFrame({"id": f.id, "think": [s[0] for s in split], "body": [s[1] for s in split], "repaired": [model_json.repaired(s[1]) for s in split], "parsed": [json.dumps(model_json.parsed(a)) for a in f.answer]})

    return ANSWERS.df(spark).mapInPandas(run, "id long, think string, body string, repaired string, parsed string")


def length_judge(prompt: str) -> str:
    """A stand-in for a model: deterministic, and failing where the sentence says so."""
    sentence = prompt.split("Sentence: ", 1)[-1].split("\n", 1)[0]
    if len(sentence) > 2000:
        raise TimeoutError("too long")
    return json.dumps({"issues": [{"issue_type": "long_sentence", "severity": "low"}] if len(sentence) > 200 else []})


@catalog.add(
    "judge",
    f"""WITH {text_queries.FEATURES}, j AS (SELECT doc_id, sent_idx, length(string_split(sentence, chr(10))[1]) AS n FROM feat WHERE n_cliches > 0)
SELECT doc_id, sent_idx, '' AS think, CASE WHEN n > 2000 THEN 'api_request_error' WHEN n > 200 THEN 'long_sentence' ELSE '' END AS issues FROM j""",
)
def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_queries.features(spark, sf_dir).where("n_cliches > 0").withColumn("prompt", models.style_prompt(F.lit("plain"), F.lit(""), F.col("sentence"), F.lit(""), F.col("n_words").cast("string")))
    out = models.judged(rows, ["doc_id", "sent_idx"], "prompt", length_judge)
    return out.select("doc_id", "sent_idx", "think", F.array_join(F.transform("issues", lambda i: i["issue_type"]), "|").alias("issues"))


NLI = Rows("nli", "id long, claim string, snippets string", [(1, "claim", ""), (2, "claim", "Some evidence text|other"), (3, "fail", "text"), (4, "odd", "text")])


def quoting_judge(prompt: str) -> str:
    if "fail" in prompt:
        raise ConnectionError("no route")
    return json.dumps({"status": "SUPPORTED" if "odd" not in prompt else "MAYBE", "evidence": "some EVIDENCE, text" if "odd" not in prompt else "nothing like it"})


@catalog.add("nli_judge")
def nli_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NLI.df(spark).withColumn("snippets", F.filter(F.split("snippets", r"\|"), lambda s: s != ""))
    return models.audited(rows, ["id"], "claim", "snippets", quoting_judge)


def sentence_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence results with running risks and one integrity warning per document with a number sign."""
    # Dealt by document before it is cut into sentences, so that nothing needs to move afterwards.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    rows = sentences.features(sentences.split(docs), text_queries.CLICHES, text_queries.CONNECTORS)
    kind = F.when(F.col("n_cliches") > 0, "cliche")
    body = risk.running_risks(rows, keep=("sentence", "n_cliches")).select(
        "doc_id", F.col("sent_idx").alias("idx"), F.col("sentence").alias("text"), F.when(kind.isNotNull(), "flagged").otherwise("passed").alias("status"), kind.alias("issue_type"), F.when(kind.isNotNull(), "low").alias("severity"), F.lit(None).cast("double").alias("ppl"), *risk.RISKS
    )
    warned = docs.where("text LIKE '%#%'").select("doc_id", F.lit(-1).alias("idx"), F.lit("number sign").alias("text"), F.lit("flagged").alias("status"), F.lit("integrity").alias("issue_type"), F.lit("high").alias("severity"), F.lit(None).cast("double").alias("ppl"), *[F.lit(0.0).alias(r) for r in risk.RISKS])
    return warned.unionByName(body)


def no_audits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, "k1", "A rather long title of a cited work", "SUPPORTED", "evidence")], "doc_id long, idx int, cite_key string, title string, status string, evidence string")


@catalog.add("report_markdown")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(sentence_results(spark, sf_dir), no_audits(spark))


@catalog.add("report_json")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(sentence_results(spark, sf_dir), no_audits(spark))


@catalog.add("event_rows")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events(sentence_results(spark, sf_dir))


@catalog.add(
    "live_risks",
    f"""WITH {text_queries.FEATURES}, sums AS (SELECT doc_id, {text_queries._summed('')} FROM feat GROUP BY doc_id), r AS (SELECT doc_id, {text_queries._RATIOS} FROM sums), w AS (SELECT DISTINCT doc_id FROM documents WHERE contains(text, '#'))
SELECT coalesce(r.doc_id, w.doc_id) AS doc_id, {", ".join(f"CAST(round({x}) AS INTEGER) AS {x}" for x in ("predictability_risk", "uniformity_risk", "translationese_risk", "redundancy_risk"))} FROM r FULL JOIN w ON w.doc_id = r.doc_id""",
)
def live_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.live_risks(sentence_results(spark, sf_dir))


@catalog.add(
    "stream_state",
    f"WITH {text_queries.FEATURES}, sums AS (SELECT doc_id, sent_idx, {text_queries._summed('OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING)')} FROM feat) SELECT doc_id, sent_idx, {text_queries._RATIOS.split(',', 1)[1]} FROM sums",
)
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as a stream through keyed state, run until it has seen all of them."""
    excess = F.expr("CAST(least(200, greatest(0, CAST(nv_ratio * 100 AS BIGINT) - 150)) AS BIGINT)")
    rows = text_queries.features(spark, sf_dir).select("doc_id", "sent_idx", "n_tokens", excess.alias("excess100"), risk.redundant().alias("is_redundant"))
    source, sink, checkpoint = (scratch(spark, f"stream-{n}") for n in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = state.running_risks(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(state.RISK_ROWS).parquet(sink)
