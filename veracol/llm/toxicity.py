"""Toxicity by compression distance.

Two zstandard dictionaries tell the classes apart: one of ordinary text, trained by zstandard where there are samples
enough (20 times its size; below, it is their end), and the same one led by a list of words that a likelihood ratio
picks from toxic texts, so that a window without any of these compresses alike under both. The toxic one isn't trained
by zstandard itself: README says why, with figures. Each window of a text is compressed under both; how many bytes fewer the toxic one needs is
its distance. Windows from a calibrated distance on are hits; hits beyond the rate at which ordinary texts have
them, by a logistic curve over training texts, give the score.

Training reads a bounded sample of labelled rows (TRAIN_TEXTS of each label, texts up to TRAIN_CHARS); every
text is scored whole. Labels, language, source and doc_id are no inputs of a score.

Defined cases: null or empty text has no windows, no hits and the score of a text without hits; windows
cover texts of any length whole; repeated rows get the same score; without labelled rows of both kinds
every score is the share of toxic labels, 0 without any label; an empty table gives an empty result; only
doc_id and text, and doc_id and toxic of the labels, are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: texts of each label, and the length up to which a text is taken.
TRAIN_TEXTS, TRAIN_CHARS = 2_000, 20_000
#: Words of a window.
WINDOW_WORDS = 2
#: Bytes of the ordinary stretch that both dictionaries have, and of what leads the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
#: Log-likelihood ratio over which a word sets toxic texts apart, and texts that must have it.
LEAST_RATIO, LEAST_TEXTS = 15.0, 3
#: A score from here on predicts label 1.
THRESHOLD = 0.3
#: Begins each window and ends each dictionary, so that no window is stored uncompressed; the tail takes the
#: last bytes of a block, in which zstandard looks for no matches.
ANCHOR = b"== a window of words of one text begins here ==\n"
TAIL = b"== it ends ===== here ==\n"
#: Excess hits count up to here; pull of the curve's slope and offset to zero.
MOST_EXCESS, RIDGE = 4.0, 0.01


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The text's words in lower case, a few at a time."""
    w = text.lower().encode().split()
    return [ANCHOR + b" " + b" ".join(w[i : i + words]) + b" " + TAIL for i in range(0, len(w), words)]


def _compressor(content: bytes):
    import zstandard as z

    # Greedy matching of four bytes or more over the whole dictionary: what a window finds depends on the
    # dictionary's content alone, so that content which both share costs the same under both.
    how = z.ZstdCompressionParameters(
        window_log=18, hash_log=19, chain_log=17, search_log=4, min_match=4, strategy=z.STRATEGY_GREEDY, target_length=32,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    content = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=content, compression_params=how).compress


def _trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary content of about `size` bytes: zstandard's choice, or the samples where they are few."""
    import zstandard as z

    if sum(map(len, samples)) < 20 * size:
        return b"\n".join(samples)[-size:]
    return z.train_dictionary(size, samples).as_bytes()


def _texts_with(texts: list[str]) -> Counter:
    """How many texts have each word, counting once those where it last stands between the same neighbours
    (copies of one text)."""
    places = set()
    for t in texts:
        w = ["", *t.lower().split(), ""]
        places.update({x: (before, x, after) for before, x, after in zip(w, w[1:], w[2:])}.values())
    return Counter(x for _, x, _ in places)


def telling_words(toxic: list[str], ordinary: list[str]) -> list[tuple[float, str]]:
    """Words that more of the toxic texts have than chance explains, with their ratio, most telling last."""
    seen = [_texts_with(texts) for texts in (toxic, ordinary)]
    n = len(toxic), len(ordinary)
    out = []
    for word, a in seen[0].items():
        b = seen[1][word]
        if a >= LEAST_TEXTS and a * n[1] > 4 * b * n[0]:
            rate = (a + b) / (n[0] + n[1])
            ratio = 2 * (a * math.log(a / (n[0] * rate)) + (b * math.log(b / (n[1] * rate)) if b else 0.0))
            if ratio >= LEAST_RATIO:
                out.append((ratio, word))
    return sorted(out)


def toxic_lead(toxic: list[str], ordinary: list[str], size: int = TOXIC_BYTES) -> bytes:
    """What sets toxic texts apart, the most telling words next to the ordinary stretch."""
    lead = (" " + " ".join(w for _, w in telling_words(toxic, ordinary)) + " ").encode()
    return lead[-size:] if len(lead) > 2 else b""


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; small and bounded, so that every task carries it."""

    ordinary: bytes
    toxic: bytes
    least_distance: int
    #: Hits of ordinary text in each window.
    rate: float
    #: Offset and slope of the logistic curve over excess hits.
    offset: float
    slope: float

    def measure(self):
        """A function from a text to (score, hits, windows)."""
        plain, toxic = _compressor(self.ordinary), _compressor(self.toxic)

        def of(text: str) -> tuple[float, int, int]:
            parts = windows(text)
            hits = sum(len(plain(w)) - len(toxic(w)) >= self.least_distance for w in parts)
            return self.score(hits, len(parts)), hits, len(parts)

        return of

    def score(self, hits: int, parts: int) -> float:
        return 1.0 / (1.0 + math.exp(-(self.offset + self.slope * min(hits - self.rate * parts, MOST_EXCESS))))


def _curve(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Offset and slope of the weighted logistic fit, by Newton steps."""
    a, at = np.c_[np.ones(len(x)), x], np.zeros(2)
    pull = RIDGE * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (label - p)) - pull @ at)
        at = at + np.clip(step, -2, 2)
    return at


def fit_texts(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from sampled texts. share: of toxic among all labelled texts.

    Two thirds of each label train the dictionaries, the others calibrate.
    """
    if not toxic or not ordinary:
        sure = min(max(share, 1e-6), 1 - 1e-6)
        return Model(ANCHOR, ANCHOR, 1, 0.0, math.log(sure / (1 - sure)) if share else -40.0, 0.0)
    parts = [([t for i, t in enumerate(x) if i % 3], x[::3]) for x in (toxic, ordinary)]
    (toxic_train, toxic_test), (plain_train, plain_test) = parts
    stretch = _trained([line.lower().encode() for t in plain_train for line in t.split("\n") if len(line) > 20], ORDINARY_BYTES)
    lead = toxic_lead(toxic_train, plain_train)
    tests = [(t, 1) for t in toxic_test] + [(t, 0) for t in plain_test]
    label = np.array([y for _, y in tests], float)
    weight = np.where(label == 1, share / max(len(toxic_test), 1), (1 - share) / max(len(plain_test), 1)) * len(tests)
    plain, keen = stretch + ANCHOR, lead + stretch + ANCHOR
    by_plain, by_keen = _compressor(plain), _compressor(keen)
    each = [np.array([len(by_plain(w)) - len(by_keen(w)) for w in windows(t)] or [0]) for t, _ in tests]
    best = None
    for least in range(1, 6):
        hits, parts = np.array([(d >= least).sum() for d in each], float), np.array([len(d) for d in each], float)
        rate = hits[label == 0].sum() / max(parts[label == 0].sum(), 1)
        x = np.minimum(hits - rate * parts, MOST_EXCESS)
        at = _curve(x, label, weight)
        p = np.clip(1 / (1 + np.exp(-(at[0] + at[1] * x))), 1e-6, 1 - 1e-6)
        loss = -(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best[0] - 1e-9:
            best = loss, least, float(rate), float(at[0]), float(at[1])
    return Model(plain, keen, *best[1:])


def fit(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Model:
    """A model from a bounded sample of the labelled rows, drawn by a hash of the id."""
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    counts = {r._toxic: r.n for r in label.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("_id", F.lit(11)), F.col("_id")
    drawn = label.where("_toxic = 1").orderBy(*order).limit(texts).unionByName(label.where("_toxic = 0").orderBy(*order).limit(texts))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= chars)
    rows = found.join(drawn, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "text").collect()
    return fit_texts([r.text for r in rows if r._toxic == 1], [r.text for r in rows if r._toxic == 0], share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, hits, windows of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.measure()
        for batch in batches:
            got = [of(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column("doc_id"), *[pa.array([g[i] for g in got], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "hits", "windows"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, hits long, windows long")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by labels of the rows that aren't held out."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = fit(docs, labels.where(~out))
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "windows")
