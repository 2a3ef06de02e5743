"""Queries over sentences, features and risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.functions import lexicons as lx
from veracol.functions import text as t
from veracol.operators import diagnosis, risk, sentences
from veracol.plans.common import Catalog, table

catalog = Catalog()

#: Phrase lists for the driver's prose, which has no Russian.
CLICHES = ("of the", "in the", "is a")
CONNECTORS = ("and the", "with the", "for the")

_TRIM = r"regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_PROTECT = r"regexp_replace(regexp_replace(text, '\$\$[\s\S]+?\$\$|\$[^$\n]+?\$', '__PROTECTED_LATEX__', 'g'), '\[\s*\d+[\s,;\-–—\d]*\s*\]', '__PROTECTED_REF__', 'g')"
SENTENCES = rf"""
pieces AS (SELECT doc_id, list_filter(list_transform(string_split({_PROTECT}, '. '), lambda s: {_TRIM}), lambda s: s <> '') AS l FROM documents),
sentences AS (SELECT doc_id, unnest(l) AS sentence, CAST(unnest(range(len(l))) AS INTEGER) AS sent_idx FROM pieces)"""


def _phrases(words: tuple[str, ...]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(lower(sentence), '{t.phrase_pattern(p)}') THEN '{p}' END" for p in words)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


FEATURES = rf"""{SENTENCES},
worded AS (SELECT *, list_filter(regexp_split_to_array(sentence, '[\s\p{{Z}}]+'), lambda x: x <> '') AS w, {_phrases(CLICHES)} AS cliches, {_phrases(CONNECTORS)} AS connectors FROM sentences),
counted AS (SELECT *, len(w) AS n_tokens, len(list_filter(w, lambda x: NOT starts_with(x, '__PROTECTED_'))) AS n_words, len(cliches) AS n_cliches, len(connectors) AS n_connectors FROM worded),
noun AS (SELECT *, n_words // 2 AS n_nouns, greatest(1, n_words // 5) AS n_verbs FROM counted),
feat AS (SELECT *, (200 * n_nouns + n_verbs) // (2 * n_verbs) AS nv100, n_tokens > 0 AND 2 * (n_tokens - n_words) > n_tokens AS is_protected,
  8 * CAST(n_cliches > 0 AS INT) + 3 * CAST((200 * n_nouns + n_verbs) // (2 * n_verbs) > 350 AS INT) + 2 * CAST(n_connectors > 1 AS INT) >= 5 AS is_redundant FROM noun)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.features(sentences.split(table(spark, sf_dir, "documents")), CLICHES, CONNECTORS)


@catalog.add("sentence_split", f"WITH {SENTENCES} SELECT doc_id, sent_idx, sentence FROM sentences")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


@catalog.add("sentence_features", f"WITH {FEATURES} SELECT doc_id, sent_idx, n_tokens, n_words, n_nouns, n_verbs, nv100 / 100.0 AS nv_ratio, n_cliches, n_connectors, is_protected FROM feat")
def sentence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir).withColumn("nv_ratio", F.col("nv_ratio").cast("double"))
    return df.select("doc_id", "sent_idx", "n_tokens", "n_words", "n_nouns", "n_verbs", "nv_ratio", "n_cliches", "n_connectors", "is_protected")


@catalog.add(
    "span_protection",
    rf"WITH p AS (SELECT doc_id, {_PROTECT} AS protected FROM documents) SELECT doc_id, len(regexp_extract_all(protected, '__PROTECTED_LATEX__')) AS n_latex, len(regexp_extract_all(protected, '__PROTECTED_REF__')) AS n_ref, length(protected) AS n_chars FROM p",
)
def span_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", t.protect(F.col("text")).alias("protected"))
    count = lambda name: F.size(F.regexp_extract_all("protected", F.lit(f"(__PROTECTED_{name}__)"), 1)).cast("long")
    return df.select("doc_id", count("LATEX").alias("n_latex"), count("REF").alias("n_ref"), F.length("protected").cast("long").alias("n_chars"))


@catalog.add(
    "lexicon_hits",
    f"WITH {FEATURES}, hits AS (SELECT doc_id, unnest(list_concat(cliches, connectors)) AS phrase FROM feat) SELECT doc_id, phrase, count(*) AS n_sentences FROM hits GROUP BY ALL",
)
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = features(spark, sf_dir).select("doc_id", F.explode(F.concat("cliches", "connectors")).alias("phrase"))
    return hits.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n_sentences"))


_GATE = "NOT is_protected AND n_words >= 6"


@catalog.add(
    "probe_gate",
    f"WITH {FEATURES} SELECT doc_id, sent_idx, {_GATE} AS deep, {_GATE} AND (n_words >= 12 OR n_cliches > 0) AS smart, {_GATE} AND (n_words >= 18 OR n_cliches > 0) AS fast, false AS other FROM feat",
)
def probe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = {"deep": "Deep Probe", "smart": "Smart Probe", "fast": "Fast Probe", "other": "Unknown"}
    return features(spark, sf_dir).select("doc_id", "sent_idx", *[sentences.probe(m).alias(k) for k, m in modes.items()])


@catalog.add(
    "doc_length_stats",
    f"""WITH {FEATURES}, sums AS (SELECT doc_id, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS s, CAST(sum(n_tokens * n_tokens) AS BIGINT) AS s2, CAST(sum(n_cliches) AS BIGINT) AS c, CAST(sum(n_connectors) AS BIGINT) AS k FROM feat GROUP BY doc_id)
SELECT doc_id, n AS n_sentences, CAST(s AS DOUBLE) / n AS mean_length, CASE WHEN n > 1 THEN CAST(n * s2 - s * s AS DOUBLE) / (n * n) ELSE 0.0 END AS length_variance, CAST(c AS DOUBLE) / n AS cliche_rate, CAST(k AS DOUBLE) / n AS connector_rate FROM sums""",
)
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = features(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"), F.sum(F.expr("n_tokens * n_tokens")).alias("s2"), F.sum("n_cliches").alias("c"), F.sum("n_connectors").alias("k")
    )
    return sums.selectExpr(
        "doc_id", "n AS n_sentences", "CAST(s AS DOUBLE) / n AS mean_length",
        "CASE WHEN n > 1 THEN CAST(n * s2 - s * s AS DOUBLE) / (n * n) ELSE 0.0D END AS length_variance",
        "CAST(c AS DOUBLE) / n AS cliche_rate", "CAST(k AS DOUBLE) / n AS connector_rate",
    )


@catalog.add("matched_phrases", f"WITH {FEATURES} SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(cliches)))), '|') AS phrases FROM feat GROUP BY doc_id")
def matched_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cliches"))))
    return features(spark, sf_dir).groupBy("doc_id").agg(F.array_join(every, "|").alias("phrases"))


_RATIOS = """0.0 * n AS predictability_risk,
  CASE WHEN n > 1 THEN greatest(0.0, least(100.0, (11.0 - sqrt(CAST(n * w2 - w * w AS DOUBLE)) / n) * 10.0)) ELSE 0.0 END AS uniformity_risk,
  (e / 100.0) / (n * 6) * 100 AS translationese_risk, 100 * CAST(r AS DOUBLE) / n AS redundancy_risk"""


def _summed(over: str) -> str:
    big = lambda x, name: f"CAST(sum({x}) {over} AS BIGINT) AS {name}"
    return f"count(*) {over} AS n, {big('n_tokens', 'w')}, {big('n_tokens * n_tokens', 'w2')}, {big('least(200, greatest(0, nv100 - 150))', 'e')}, {big('CAST(is_redundant AS INT)', 'r')}"


@catalog.add("doc_risks", f"WITH {FEATURES}, sums AS (SELECT doc_id, {_summed('')} FROM feat GROUP BY doc_id) SELECT doc_id, n AS n_sentences, CAST(0.0 AS DOUBLE) AS predictability_risk, {_RATIOS.split(',', 1)[1]} FROM sums")
def doc_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.document_risks(features(spark, sf_dir))


@catalog.add(
    "running_risks",
    f"WITH {FEATURES}, sums AS (SELECT doc_id, sent_idx, {_summed('OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING)')} FROM feat) SELECT doc_id, sent_idx, CAST(0.0 AS DOUBLE) AS predictability_risk, {_RATIOS.split(',', 1)[1]} FROM sums",
)
def running_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.running_risks(features(spark, sf_dir))


@catalog.add(
    "risk_levels",
    f"""WITH {FEATURES}, sums AS (SELECT doc_id, {_summed('')} FROM feat GROUP BY doc_id), r AS (SELECT doc_id, {_RATIOS} FROM sums)
SELECT CASE WHEN uniformity_risk >= 70 THEN 'high' WHEN uniformity_risk >= 40 THEN 'medium' ELSE 'low' END AS report, CASE WHEN uniformity_risk >= 60 THEN 'high' WHEN uniformity_risk >= 35 THEN 'medium' ELSE 'low' END AS screen, count(*) AS n FROM r GROUP BY ALL""",
)
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_risks(spark, sf_dir)
    return rows.groupBy(risk.report_level(F.col("uniformity_risk")).alias("report"), risk.screen_level(F.col("uniformity_risk")).alias("screen")).agg(F.count(F.lit(1)).alias("n"))


@catalog.add(
    "context_frames",
    """SELECT conv_id, turn, coalesce(string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations""",
)
def context_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@catalog.add(
    "lexical_totals",
    f"WITH {FEATURES} SELECT doc_id, count(*) AS n, CAST(sum(nv100) AS BIGINT) / 100.0 / count(*) AS mean_nv, count(*) FILTER (nv100 > 300) AS n_over, CAST(sum(n_cliches) AS BIGINT) AS n_cliches, CAST(sum(n_connectors) AS BIGINT) AS n_connectors, CAST(0 AS BIGINT) AS n_passive, CAST(0 AS BIGINT) AS n_chains FROM feat GROUP BY doc_id",
)
def lexical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("nv_ratio").cast("double") / F.count(F.lit(1))).alias("mean_nv"),
        F.count_if(F.col("nv_ratio") > 3).alias("n_over"),
        *[F.sum(c).alias(c) for c in ("n_cliches", "n_connectors", "n_passive", "n_chains")],
    )


_TEXTS = "SELECT 'documents' AS tbl, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages"


@catalog.add(
    "document_stats",
    rf"""WITH x AS ({_TEXTS}) SELECT tbl, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\s\p{{Z}}]+'), lambda w: w <> ''))) AS BIGINT) AS n_words,
CAST(sum(len(regexp_extract_all(text, '\[[^\]\n]{{1,40}}\]'))) AS BIGINT) AS n_citations FROM x GROUP BY tbl""",
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("tbl"), F.col(c).alias("text")) for n, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "tbl", F.length("text").alias("c"), F.size(t.word_list(F.col("text"))).alias("w"), F.regexp_count("text", F.lit(r"\[[^\]\n]{1,40}\]")).alias("k")
    )
    return each.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("n_chars"), F.sum("w").alias("n_words"), F.sum("k").alias("n_citations"))


@catalog.add(
    "discipline_keywords",
    "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{d}'" for d, ws in lx.DISCIPLINE_KEYWORDS) + " ELSE 'UNIVERSAL' END AS discipline FROM documents",
)
def discipline_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.first_contained(F.lower("text"), lx.DISCIPLINE_KEYWORDS, lx.DEFAULT_DISCIPLINE).alias("discipline"))


def calibrated(rows: DataFrame) -> DataFrame:
    """Adds the thresholds of each row's discipline, the default's for unknown ones. The table has six rows."""
    spark = rows.sparkSession
    calibration = spark.createDataFrame(list(lx.CALIBRATION), lx.CALIBRATION_SCHEMA)
    names = [n for n in calibration.columns if n != "discipline"]
    default = calibration.where(F.col("discipline") == lx.DEFAULT_DISCIPLINE).select(*[F.col(n).alias(f"_{n}") for n in names])
    joined = rows.join(F.broadcast(calibration), "discipline", "left").crossJoin(F.broadcast(default))
    return joined.select(*rows.columns, *[F.coalesce(n, f"_{n}").alias(n) for n in names])


_CALIBRATION = ", ".join(f"('{d}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), {p})" for d, a, b, c, p in lx.CALIBRATION)


@catalog.add(
    "calibration_join",
    f"""WITH c(d, ppl_low, ppl_high, nv_ratio_max, passive_max) AS (VALUES {_CALIBRATION}),
x AS (SELECT page_id, CASE WHEN contains(lower(html), 'art') THEN 'ARTS_SPORTS' WHEN page_id % 2 = 0 THEN 'COMPUTER_AI' ELSE 'SCI_TECH' END AS discipline FROM pages)
SELECT page_id, discipline, coalesce(c.ppl_low, u.ppl_low) AS ppl_low, coalesce(c.ppl_high, u.ppl_high) AS ppl_high, coalesce(c.nv_ratio_max, u.nv_ratio_max) AS nv_ratio_max, coalesce(c.passive_max, u.passive_max) AS passive_max
FROM x LEFT JOIN c ON c.d = discipline CROSS JOIN (SELECT * FROM c WHERE d = 'UNIVERSAL') u""",
)
def calibration_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.lower("html").contains("art"), "ARTS_SPORTS").when(F.col("page_id") % 2 == 0, "COMPUTER_AI").otherwise("SCI_TECH")
    return calibrated(table(spark, sf_dir, "pages").select("page_id", kind.alias("discipline")))


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{d}'" for d, ws in lx.DISCIPLINE_KEYWORDS) + " ELSE 'UNIVERSAL' END"
_EXPLAINED = " OR ".join(f"contains(lower(sentence), '{w}')" for w in lx.FORMULA_WORDS)


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every sentence by the rule judge, with thresholds of the document's discipline."""
    # Dealt by document, so that windows over a document's sentences need not move them.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    kinds = docs.select("doc_id", "text", t.first_contained(F.lower("text"), lx.DISCIPLINE_KEYWORDS, lx.DEFAULT_DISCIPLINE).alias("discipline"))
    rows = calibrated(kinds).withColumnRenamed("doc_id", "_doc")
    split = rows.select(F.col("_doc").alias("doc_id"), "ppl_low", "ppl_high", "nv_ratio_max", F.posexplode(t.sentence_list(t.protect(F.col("text")))).alias("sent_idx", "sentence"))
    return diagnosis.diagnosed(sentences.features(split, CLICHES, CONNECTORS))


@catalog.add(
    "diagnosis",
    f"""WITH {FEATURES}, c(d, ppl_low, ppl_high, nv_ratio_max, passive_max) AS (VALUES {_CALIBRATION}), kinds AS (SELECT doc_id, {_KIND} AS d FROM documents),
w AS (SELECT *, nv100 > 450 AS stacked, n_verbs = 0 AND n_words > 8 AS verbless, contains(sentence, '__PROTECTED_LATEX') AND NOT ({_EXPLAINED}) AS bare FROM feat JOIN kinds USING (doc_id) JOIN c USING (d)),
r AS (SELECT *, CASE WHEN n_cliches > 0 OR nv100 / 100.0 > nv_ratio_max OR stacked OR verbless OR bare THEN 'judge' ELSE 'passed' END AS route FROM w),
j AS (SELECT *, route = 'judge' AND n_words > {diagnosis.MOST_WORDS} AS judge_error,
  CASE WHEN route <> 'judge' THEN NULL WHEN n_words > {diagnosis.MOST_WORDS} THEN 'json_parse_error' WHEN stacked THEN 'translationese_noun_stacking' WHEN verbless THEN 'translationese_verb_deficiency' WHEN bare THEN 'style_formula_unexplained' WHEN n_cliches > 0 THEN 'style_cliche' END AS issue_type FROM r),
s AS (SELECT *, CASE WHEN judge_error OR issue_type IS NULL THEN 'passed' ELSE 'flagged' END AS status FROM j),
sums AS (SELECT doc_id, sent_idx, route, status, issue_type, judge_error, {_summed('OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING)')},
  CAST(count(*) FILTER (status = 'flagged') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS f, CAST(count(*) FILTER (judge_error) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS u FROM s)
SELECT doc_id, sent_idx, route, status, issue_type, judge_error, 100 * CAST(f AS DOUBLE) / greatest(1, n - u) AS predictability_risk, {_RATIOS.split(',', 1)[1]} FROM sums""",
)
def diagnosis_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.with_risks(diagnosed(spark, sf_dir))
