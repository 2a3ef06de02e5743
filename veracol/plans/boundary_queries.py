"""Queries over learned sentence boundaries and over chains in sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.functions import text as t
from veracol.operators import boundaries, chains
from veracol.plans.common import Catalog, table
from veracol.plans.text_queries import SENTENCES, sentence_split

catalog = Catalog()

_LEARNED = rf"""tokens AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s\p{{Z}}]+'), lambda w: w <> '')) AS w FROM documents),
counts AS (SELECT lower(regexp_replace(w, '\.$', '')) AS word, count(*) AS total, count(*) FILTER (ends_with(w, '.')) AS stops FROM tokens GROUP BY 1),
sums AS (SELECT CAST(sum(total) AS DOUBLE) AS n, CAST(sum(stops) AS DOUBLE) AS n_stops FROM counts),
scored AS (SELECT word, total, stops, total - stops AS bare, length(replace(word, '.', '')) AS letters, n, n_stops FROM counts, sums WHERE stops > 0 AND n_stops < n AND regexp_matches(word, '\p{{L}}')),
short AS (SELECT word FROM scored WHERE 2 * (stops * ln({boundaries.CLINGS}) + bare * ln({1 - boundaries.CLINGS}) - stops * ln(n_stops / n) - bare * ln(1 - n_stops / n)) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -least(bare, 300)) >= {boundaries.LEAST_ABBREVIATION}),
cut AS (SELECT doc_id, unnest(string_split(text, '. ')) AS piece, unnest(range(len(string_split(text, '. ')))) AS n FROM documents),
sides AS (SELECT *, lower(list_filter(regexp_split_to_array(piece, '[\s\p{{Z}}]+'), lambda w: w <> '')[-1]) AS last, lower(list_filter(regexp_split_to_array(piece, '[\s\p{{Z}}]+'), lambda w: w <> '')[1]) AS head FROM cut),
ahead AS (SELECT *, regexp_replace(lead(head) OVER (PARTITION BY doc_id ORDER BY n), '\.$', '') AS next FROM sides),
opens AS (SELECT next AS word, count(*) AS k1 FROM ahead WHERE next IS NOT NULL AND (last IS NULL OR last NOT IN (SELECT word FROM short)) GROUP BY 1),
breaks AS (SELECT CAST(sum(k1) AS DOUBLE) AS n1 FROM opens),
table2 AS (SELECT word, CAST(least(k1, total) AS DOUBLE) AS k1, CAST(greatest(total - k1, 0) AS DOUBLE) AS k2, n1, n - n1 AS n2, total / n AS p FROM opens JOIN counts USING (word), sums, breaks WHERE n1 < n AND regexp_matches(word, '\p{{L}}')),
llr AS (SELECT word, k1, k2, n1, n2, 2 * (
    CASE WHEN k1 > 0 THEN k1 * (ln(k1 / n1) - ln(p)) ELSE 0 END + CASE WHEN n1 > k1 THEN (n1 - k1) * (ln(1 - k1 / n1) - ln(1 - p)) ELSE 0 END
  + CASE WHEN k2 > 0 THEN k2 * (ln(k2 / n2) - ln(p)) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * (ln(1 - k2 / n2) - ln(1 - p)) ELSE 0 END) AS score FROM table2),
starters AS (SELECT word FROM llr WHERE k1 / n1 > k2 / n2 AND score >= {boundaries.LEAST_STARTER}),
marked AS (SELECT *, CAST(last IS NULL OR last NOT IN (SELECT word FROM short) OR coalesce(next IN (SELECT word FROM starters), FALSE) AS INT) AS ends FROM ahead),
runs AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM marked),
merged AS (SELECT doc_id, run, regexp_replace(string_agg(piece, '. ' ORDER BY n), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS sentence FROM runs GROUP BY doc_id, run)"""


@catalog.add("learned_sentences", f"WITH {_LEARNED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS sent_idx, sentence FROM merged WHERE sentence <> ''")
def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.split(table(spark, sf_dir, "documents").select("doc_id", "text"))


def by_length(sentence: Column) -> tuple[Column, Column]:
    """A stand-in for a parser: a word's head is the one before it, or the second before it for words of odd length; words of
    four characters or more are marked."""
    words = t.word_list(sentence)
    return F.transform(words, lambda w, i: i - 1 - F.length(w) % 2), F.transform(words, lambda w: F.length(w) >= 4)


@catalog.add(
    "longest_chains",
    rf"""WITH RECURSIVE {SENTENCES.strip()}, worded AS (SELECT doc_id, sent_idx, list_filter(regexp_split_to_array(sentence, '[\s\p{{Z}}]+'), lambda w: w <> '') AS w FROM sentences),
tok AS (SELECT doc_id, sent_idx, CAST(unnest(range(len(w))) AS INTEGER) AS i, length(unnest(w)) AS n FROM worded),
walk AS (SELECT doc_id, sent_idx, i - 1 - CAST(n % 2 AS INTEGER) AS head, 1 AS long FROM tok WHERE n >= 4 UNION ALL
  SELECT k.doc_id, k.sent_idx, k.i - 1 - CAST(k.n % 2 AS INTEGER), long + 1 FROM walk w JOIN tok k ON k.doc_id = w.doc_id AND k.sent_idx = w.sent_idx AND k.i = w.head AND k.n >= 4),
best AS (SELECT doc_id, sent_idx, max(long) AS chain FROM walk GROUP BY ALL)
SELECT doc_id, sent_idx, CAST(coalesce(chain, 0) AS BIGINT) AS chain, FALSE AS cyclic FROM sentences LEFT JOIN best USING (doc_id, sent_idx)""",
)
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.with_chains(sentence_split(spark, sf_dir), by_length).drop("sentence")
